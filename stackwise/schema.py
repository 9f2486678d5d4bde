"""Tables of the catalog: fixed schemas, and additive evolution of older snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _LONG, _REAL, _INT = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


#: One row per file; a missing value is '' or 0, never null.
CATALOG = _struct(
    id=_LONG, path=_TEXT, filename=_TEXT, ext=_TEXT, size=_LONG, mtime=_REAL, title=_TEXT, authors=_TEXT, description=_TEXT, language=_TEXT, publisher=_TEXT,
    published_year=_TEXT, isbn=_TEXT, source=_TEXT, remote_source=_TEXT, remote_url=_TEXT, douban_rating=_TEXT, douban_url=_TEXT, douban_rating_status=_TEXT,
    cover_path=_TEXT, tags_text=_TEXT, status=_TEXT, quarantine_path=_TEXT, scan_error=_TEXT, added_at=_REAL, updated_at=_REAL, last_scanned_at=_REAL,
    last_remote_lookup_at=_REAL, remote_lookup_version=_INT,
)
BOOK_TAGS = _struct(book_id=_LONG, tag=_TEXT)
OP_BATCHES = _struct(id=_TEXT, kind=_TEXT, status=_TEXT, confirm_phrase=_TEXT, item_count=_LONG, total_size=_LONG, created_at=_REAL, started_at=_REAL, completed_at=_REAL, output_path=_TEXT, error=_TEXT)
OP_ITEMS = _struct(operation_id=_TEXT, position=_INT, book_id=_LONG, path=_TEXT, size=_LONG, mtime=_REAL, title=_TEXT, status=_TEXT, quarantine_path=_TEXT, error=_TEXT)
JOBS = _struct(id=_TEXT, kind=_TEXT, status=_TEXT, message=_TEXT, processed=_LONG, total=_LONG, created_at=_REAL, updated_at=_REAL, state_json=_TEXT)
#: What the readers make of a file: null where the file says nothing.
EXTRACTED = T.StructType([*_struct(title=_TEXT, authors=_TEXT, description=_TEXT, language=_TEXT, publisher=_TEXT, published_year=_TEXT, isbn=_TEXT, cover_path=_TEXT).fields, T.StructField("subjects", T.ArrayType(_TEXT)), T.StructField("scan_error", _TEXT)])
CANDIDATE = _struct(title=_TEXT, rating=_TEXT, cast=_TEXT, summary=_TEXT, url=_TEXT)

#: Values of missing columns that aren't the type's empty value.
DEFAULTS = {"source": "local", "status": "active"}


def empty_value(field: T.StructField):
    """The missing marker of a column."""
    if field.name in DEFAULTS:
        return DEFAULTS[field.name]
    return "" if isinstance(field.dataType, T.StringType) else 0


def evolve(df: DataFrame, schema: T.StructType = CATALOG) -> DataFrame:
    """df with exactly the schema's columns: missing ones and nulls get the missing marker, further columns go. One projection."""
    have = set(df.columns)
    columns = []
    for f in schema.fields:
        marker = F.lit(empty_value(f)).cast(f.dataType)
        columns.append((F.coalesce(df[f.name].cast(f.dataType), marker) if f.name in have else marker).alias(f.name))
    return df.select(*columns)
