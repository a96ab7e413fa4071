"""Writers: an ELF program for each image, and JSON documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.functions.scalar import hex_address
from firmlake.sources.elf import program, unique_names

# Section names by region.
SECTIONS = {"drom": ".flash.rodata", "irom": ".flash.text", "iram": ".iram0.text", "diram_iram": ".iram0.text", "dram": ".dram0.data", "diram_dram": ".dram0.data", "rtc_iram": ".rtc.text", "rtc_dram": ".rtc.data", "rtc_data": ".rtc.slow"}


def elf_files(segments: DataFrame) -> DataFrame:
    """Segments with bytes -> (image_id, elf binary): one program an image, its non-empty segments as named sections."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted((r for r in table.to_pylist() if r["data"]), key=lambda r: (r["load_addr"], r["index"]))
        names = unique_names([SECTIONS.get(r["region"], f".{r['region'] or 'segment'}") for r in rows])
        data = program([(n, r["load_addr"], r["data"], bool(r["executable"])) for n, r in zip(names, rows, strict=True)], rows[0]["entry_addr"]) if rows else None
        return pa.Table.from_pylist([{"image_id": table.column("image_id")[0].as_py(), "elf": data}], schema=pa.schema([("image_id", pa.string()), ("elf", pa.binary())]))

    return segments.select("image_id", "entry_addr", "index", "load_addr", "executable", "region", "data").groupBy("image_id").applyInArrow(run, "image_id string, elf binary")


def envelope(df: DataFrame, command: str, version: str = "1") -> DataFrame:
    """One JSON document a row: command, provenance, warnings, result; boundaries with their derived fields."""
    df = with_computed(df) if {"entry", "ranges", "callees"} <= set(df.columns) else df
    result = F.struct(*[c for c in df.columns if c != "warnings"])
    warnings = F.col("warnings") if "warnings" in df.columns else F.array().cast("array<string>")
    return df.select(F.to_json(F.struct(F.lit(command).alias("command"), F.struct(F.lit(version).alias("version")).alias("provenance"), warnings.alias("warnings"), result.alias("result"))).alias("json"))


def with_computed(boundaries: DataFrame) -> DataFrame:
    """Derived fields that documents carry beside the stored ones."""
    return boundaries.withColumns({"entry_hex": hex_address(F.col("entry")), "range_count": F.size("ranges"), "callee_count": F.size("callees")})
