"""Signatures from build artifacts: object files in archives, and linked programs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.errors import ParseError
from firmlake.functions.scalar import bundled_version, component_of, toolchain_id
from firmlake.operators import canon, graph
from firmlake.operators.match import carry_components
from firmlake.sources.decode import INSTRUCTION, Decoder, builtin, c_string
from firmlake.sources.elf import Elf, ar_members

NAMES = "path string, member string, value long, name string"
FUNCTION = "fn string, path string, member string, ord int, name string, origin string, vaddr long"
TOGETHER = 1024  # instruction rows handed on together, or as many more as an object has
ROWS = f"{FUNCTION}, {INSTRUCTION}, literal_text string"


def functions_of(data: bytes, path: str, member: str, origin: str, decoder: Decoder) -> Iterator[dict]:
    """Instruction rows of each sized function of a program; calls by address get their symbol's name, literals their word and text."""
    elf = Elf(data)
    names = {s["value"]: s["name"] for s in elf.functions() if s["value"]}  # of one address the last
    sections = [s for s in elf.sections if s.allocated and s.data]
    linked = origin == "linked"

    def at(addr: int, data_only: bool = False):
        return next(((s.data, addr - s.addr) for s in sections if s.addr <= addr < s.addr + len(s.data) and not (data_only and s.code)), None)

    for k, f in enumerate(elf.extracted()):
        key = f"{path}#{member}#{k}"
        for i in decoder(f["value"], f["data"]):
            value = text = None
            symbol = names.get(i["target"]) if linked and i["cls"] == "call" else i["target_symbol"]
            if i["cls"] == "literal_load" and linked and i["target"] is not None:
                if (place := at(i["target"])) and place[1] + 4 <= len(place[0]):
                    value = int.from_bytes(place[0][place[1] : place[1] + 4], "little")
                    if words := at(value, data_only=True):
                        text = c_string(*words)
            yield {"fn": key, "path": path, "member": member, "ord": k, "name": f["name"], "origin": origin, "vaddr": f["value"] if linked else None} | i | {"literal_value": value if value is not None else i["literal_value"], "target_symbol": symbol, "literal_text": text}


def harvested(files: DataFrame, decoder: Decoder = builtin) -> DataFrame:
    """(path, content) of archives and programs -> instruction rows by function. Files that can't be read give none."""
    kind = T._parse_datatype_string(ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        held = []
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = data[:8] == b"!<arch>\n"
                for member, body in ar_members(data) if archive else [("", data)]:
                    try:
                        held += list(functions_of(body, path, member, "archive" if archive else "linked", decoder))
                    except (ParseError, IndexError, ValueError):
                        continue
                    if len(held) >= TOGETHER:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.select("path", "content").mapInArrow(run, kind)


def function_names(files: DataFrame) -> DataFrame:
    """(path, member, value, name): named function addresses of each program or object, of one address the last name."""
    kind = T._parse_datatype_string(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        held = []
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for member, body in ar_members(data) if data[:8] == b"!<arch>\n" else [("", data)]:
                    try:
                        last = {f["value"]: f["name"] for f in Elf(body).functions() if f["value"]}
                    except (ParseError, IndexError, ValueError):
                        continue
                    held += [{"path": path, "member": member, "value": v, "name": n} for v, n in last.items()]
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=to_arrow_schema(kind))
                held = []

    return files.select("path", "content").mapInArrow(run, kind)


def named_edges(forms: DataFrame, names: DataFrame) -> DataFrame:
    """Forms (with fn, path, member) whose call targets have names get these as call_edges, one for each target; others keep theirs."""
    calls = forms.select("fn", "path", "member", F.posexplode("call_targets").alias("pos", "value"))
    calls = calls.join(names.select("path", "member", "value", F.col("name").alias("callee")), ["path", "member", "value"], "left")
    named = calls.groupBy("fn").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("callee", F.lit(canon.CALL)).alias("edge")))).alias("e"), F.count("callee").alias("some")).where("some > 0")
    df = forms.join(named.select("fn", F.transform("e", lambda x: x["edge"]).alias("named")), "fn", "left")
    return df.withColumn("call_edges", F.coalesce("named", "call_edges")).drop("named")


def signatures(rows: DataFrame, tag: str = canon.TAG, names: DataFrame | None = None) -> DataFrame:
    """One row a function with its form, component and object. With ``names``, call edges are the callees' names. Linked functions take their component from the last archive that defines the name.

    Archive copies and linked copies both stay, on purpose.
    """
    about = ("path", "member", "ord", "name", "origin", "vaddr")
    df = graph.settled(canon.forms(rows.select(*[c.split()[0] for c in canon.SCHEMA.split(", ")], *about), tag, about))  # read several times below
    if names is not None:
        df = graph.settled(named_edges(df, names))  # or the files would be read for names again
    df = df.withColumn("component", F.when(F.col("origin") == "archive", component_of(F.col("path")))).withColumn("object", F.nullif(F.col("member"), F.lit("")))
    archived = df.where("origin = 'archive'")
    linked = carry_components(df.where("origin = 'linked'"), archived.select("name", "component", "path", "member", "ord"))
    return archived.unionByName(linked.select(*archived.columns))


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """The archives and programs of artifact folders at any depth: those in ``archives/*.a`` and ``app/*.elf``."""
    read = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return read("*.a").where(F.col("path").rlike("/archives/[^/]*$")).unionByName(read("*.elf").where(F.col("path").rlike("/app/[^/]*$"))).select("path", "content")


def marker(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(path, value): a text file of the folder as one row; none if it isn't there."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select(F.input_file_name().alias("path"), "value")


def libraries(listing: DataFrame) -> DataFrame:
    """(path, value) of package listings, a header and then lines that end in version and place -> (path, library) as ``name@version``."""
    rows = listing.select("path", F.posexplode(F.split("value", "\n")).alias("at", "line")).where("at > 0")
    words = rows.select("path", "at", F.split(F.btrim(F.regexp_replace("line", r"\s+", " ")), " ").alias("w")).where(F.size("w") >= 2)
    name = F.coalesce(F.nullif(F.array_join(F.slice("w", F.lit(1), F.size("w") - 2), " "), F.lit("")), F.get("w", F.lit(0)))
    return words.select("path", "at", F.concat(name, F.lit("@"), F.get("w", F.size("w") - 2)).alias("library"))


def about(spark: SparkSession, folder: str) -> tuple[dict, list[str]]:
    """What an artifact folder's markers say of the build (config_text, toolchain, version, libraries), and warnings for what is missing."""
    first = lambda df: next((r[0] for r in df.limit(1).collect()), None)
    config = first(marker(spark, folder, "sdkconfig.out").orderBy("path").select("value"))
    tool = first(marker(spark, folder, "objdump_version.txt").orderBy("path").select(toolchain_id(F.col("value"))))
    version = first(marker(spark, folder, "bundled_idf.txt").orderBy("path").select(bundled_version(F.col("value"))))
    held = [r[0] for r in libraries(marker(spark, folder, "arduino-libs.txt")).orderBy("path", "at").select("library").limit(10_000).collect()]
    doubts = [] if config is not None else ["no resolved configuration; the build's hash says little"]
    if not artifacts(spark, folder).where(F.col("path").endswith(".a")).limit(1).count():
        doubts.append("no archives: components are unknown and fewer functions will be found")
    return {"config_text": config or "", "toolchain": tool, "version": version, "libraries": held}, doubts
