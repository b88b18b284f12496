from regiolens.sources.loader import derive_columns, load_directory, load_file  # noqa: F401
from regiolens.sources.tpch import (  # noqa: F401
    dirty_enrollment_from_tpch,
    enrollment_from_tpch,
    read_table,
)
