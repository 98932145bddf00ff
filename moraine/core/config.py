"""Table settings: the option keys writers understand, and what they mean to Spark."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .errors import FeatureUnsupported, InvalidData

# Option names and defaults of the table settings.
PREFIX = "iceberg.table."
_KEYS = {
    "parquet_writer.enable_bloom_filter": ("bloom_filter", bool),
    "parquet_writer.created_by": ("created_by", str),
    "parquet_writer.compression": ("compression", str),
    "parquet_writer.compression_level": ("compression_level", int),
    "parquet_writer.max_row_group_size": ("max_row_group_size", int),
    "parquet_writer.write_batch_size": ("write_batch_size", int),
    "parquet_writer.data_page_size": ("data_page_size", int),
    "datafile.rows_per_file": ("rows_per_file", int),
    "datafile.target_file_size_in_bytes": ("target_file_size", int),
    "sorted_delete_position_writer.max_record_num": ("delete_max_records", int),
}
_ZLIB_LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")
CODECS = ("uncompressed", "snappy", "gzip", "lzo", "brotli", "lz4", "zstd", "lz4_raw")


@dataclass(frozen=True)
class TableConfig:
    """``rows_per_file`` is an upper bound (0: none): Spark cuts exactly there. Files are also cut at about
    ``target_file_size`` (0: nowhere)."""

    bloom_filter: bool = False
    created_by: str | None = None
    compression: str = "snappy"
    compression_level: int | None = None
    max_row_group_size: int | None = None
    write_batch_size: int | None = None
    data_page_size: int | None = None
    rows_per_file: int = 0
    target_file_size: int = 1 << 20
    delete_max_records: int = 0

    @staticmethod
    def parse(options: dict[str, str]) -> TableConfig:
        """From option strings; unknown keys below the prefix are errors, other keys are ignored."""
        got = {}
        for key, text in options.items():
            if not key.startswith(PREFIX):
                continue
            if key[len(PREFIX) :] not in _KEYS:
                raise InvalidData("unknown table option", key=key)
            name, kind = _KEYS[key[len(PREFIX) :]]
            try:
                got[name] = {"true": True, "false": False}[str(text).lower()] if kind is bool else kind(text)
            except (KeyError, ValueError) as e:
                raise InvalidData("bad option value", e, key=key, value=text) from e
        config = TableConfig(**got)
        if config.compression.lower() not in CODECS:
            raise InvalidData("unknown codec", codec=config.compression)
        if any(getattr(config, f.name) is not None and isinstance(getattr(config, f.name), int) and getattr(config, f.name) < 0 for f in fields(config)):
            raise InvalidData("option values cannot be negative")
        return config

    def writer_options(self, bloom_columns: list[str] = ()) -> dict[str, str]:
        """Options of ``DataFrameWriter.parquet``; what that writer cannot do is refused."""
        out = {"compression": "none" if self.compression == "uncompressed" else self.compression.lower()}
        if self.rows_per_file:
            out["maxRecordsPerFile"] = str(self.rows_per_file)
        if self.bloom_filter:
            out |= {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom_columns}
        for value, key in ((self.max_row_group_size, "parquet.block.row.count.limit"), (self.data_page_size, "parquet.page.size")):
            if value:
                out[key] = str(value)
        if self.write_batch_size:  # values between two looks at a page's size
            out |= {"parquet.page.size.row.check.min": str(self.write_batch_size), "parquet.page.size.row.check.max": str(max(self.write_batch_size, 10_000))}
        if self.compression_level is not None:
            if self.compression.lower() == "zstd":
                out["parquet.compression.codec.zstd.level"] = str(self.compression_level)
            elif self.compression.lower() == "gzip" and self.compression_level <= 9:
                out["zlib.compress.level"] = _ZLIB_LEVELS[self.compression_level]
            else:
                raise FeatureUnsupported("compression level", codec=self.compression, level=self.compression_level)
        if self.created_by is not None:
            raise FeatureUnsupported("Spark's Parquet writer names itself in its files", created_by=self.created_by)
        return out
