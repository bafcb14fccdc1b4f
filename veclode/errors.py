"""Messages of the errors that users see."""

MISSING = "File does not exist"
BAD_COLUMNS = "columns must be either a string or a list of strings"
NOTHING = "Both tdata and vdata cannot be None"
NOT_DICT = "vdata must be a dictionary"
NOT_ARRAY = "Input must be a numpy array"
BAD_RANK = "Vector must be 2D or 3D"
EMPTY = "Empty table"
SCHEMA = "Schema of new data does not match the file schema"
VECTOR_COUNT = "Number of vectors does not match"
NO_INDICES = "row_indices cannot be empty"
NO_VECTORS = "No vector data in file"


def no_column(name: str) -> ValueError:
    return ValueError(f"Column '{name}' not found")


def no_vector(name: str) -> ValueError:
    return ValueError(f"Vector '{name}' not found")


def bad_input(kind: str) -> ValueError:
    return ValueError(f"Unsupported input type: {kind}")


def bad_dtype(kind: str) -> ValueError:
    return ValueError(f"Unsupported dtype: {kind}")


def bad_metric(name: object) -> ValueError:
    return ValueError(f"Unsupported metric: {name}")


def out_of_bounds(index: int, rows: int) -> IndexError:
    return IndexError(f"Row index {index} out of bounds for {rows} rows")
