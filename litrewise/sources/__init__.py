"""Reading raw price files and keeping intermediate stages."""

from litrewise.sources.clustered import write_clustered_stage
from litrewise.sources.incremental import refresh_stage
from litrewise.sources.prices import RAW_SCHEMA, read_price_files
from litrewise.sources.rejects import read_price_files_checked
from litrewise.sources.stages import (
    materialize,
    read_stage,
    register_view,
    stage_sketches,
    write_sketched_stage,
    write_stage,
)

__all__ = [
    "RAW_SCHEMA",
    "materialize",
    "read_price_files",
    "read_price_files_checked",
    "read_stage",
    "refresh_stage",
    "register_view",
    "stage_sketches",
    "write_clustered_stage",
    "write_sketched_stage",
    "write_stage",
]
