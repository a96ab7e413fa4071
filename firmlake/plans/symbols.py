"""From images to named functions: parse, recover, canonicalise, match, lay out. All images of a table at once."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.errors import ParseError
from firmlake.functions.scalar import describe_build
from firmlake.operators import canon, graph, layout, match
from firmlake.operators.corpus import Corpus
from firmlake.sources import flash, recover
from firmlake.sources.decode import Decoder, builtin

LOW_COVERAGE = 0.5


def analysed(files: DataFrame, slot: str | None = None, decoder: Decoder = builtin, memo: str | None = None) -> dict[str, DataFrame]:
    """(path, content) -> parsed, segments, boundaries, instructions, forms.

    With ``memo``, files are parsed and recovered once and read from tables by all that follows; without it, each use does so anew.
    """
    parsed = graph.settled(flash.parse(files, slot)) if memo else flash.parse(files, slot)
    segments = flash.segment_bytes(parsed.where("error IS NULL AND chip IS NOT NULL"), files)
    recovered = remembered(files, memo, slot, decoder, parsed) if memo else recover.recovered(segments.where("length > 0"), decoder)
    code = recover.instructions(recovered)
    keyed = code.withColumn("fn", F.concat_ws(":", "image_id", F.col("fn").cast("string")))
    return {"parsed": parsed, "segments": segments, "boundaries": recover.boundaries(recovered), "instructions": code, "forms": canon.forms(keyed)}


def remembered(files: DataFrame, memo: str, slot: str | None = None, decoder: Decoder = builtin, parsed: DataFrame | None = None) -> DataFrame:
    """(path, content) -> one recovered row an image, with its sha256; rows of a memo table are reused, new ones are added to it.

    The memo is keyed by content, slot, the versions of recovery and of the rules, and the decoder, so a file that was seen under another
    name isn't analysed again, and no decoder gets another's results. The chosen image's offset and chip are kept with the row.
    ``parsed``: the files as parsed, if they are already.
    """
    spark, version = files.sparkSession, ":".join([recover.VERSION, str(canon.VERSION), f"{decoder.__module__}.{decoder.__qualname__}", slot or ""])
    parsed = (flash.parse(files, slot) if parsed is None else parsed).where("error IS NULL AND chip IS NOT NULL")
    try:
        known = spark.read.parquet(memo)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    fresh = flash.memo_missing(parsed, known, version) if known is not None else parsed
    rows = recover.recovered(flash.segment_bytes(fresh, files).where("length > 0"), decoder)
    chosen = fresh.select("image_id", "sha256", "chip", F.get("images", F.col("selected_image"))["file_offset"].alias("image_offset")).dropDuplicates(["sha256"])
    rows = rows.join(chosen, "image_id").withColumn("version", F.lit(version))
    rows.write.mode("append").parquet(memo)
    return spark.read.parquet(memo).where(F.col("version") == version).join(parsed.select("sha256").distinct(), "sha256", "left_semi")


def symbols(analysis: dict[str, DataFrame], corpus: Corpus, chip: str | None = None, canon_version: int = canon.VERSION) -> dict[str, DataFrame]:
    """Identified and unidentified functions, regions, coverage and warnings. Each image is matched against the builds of its own chip;
    with ``chip``, only images of that one are.

    What grows with the corpus, as rivals, builds and signatures of a digest, is held once a digest, and joins a function's row only
    where it is asked for; ``rivals`` and ``builds`` count them.
    """
    if chip is None:
        chips = sorted(r["chip"] for r in analysis["parsed"].where("chip IS NOT NULL AND error IS NULL").select("chip").distinct().collect())  # one of a few supported
        if not chips:
            raise ParseError("no image of a known chip among the inputs")
        each = [symbols(analysis, corpus, c, canon_version) for c in chips]
        out = {name: reduce(DataFrame.unionByName, (e[name] for e in each)) for name in each[0]}
        return out | {"identified": out["identified"].orderBy("image_id", "entry"), "unidentified": out["unidentified"].orderBy("image_id", F.desc("size"), F.desc("in_degree"), "entry")}
    builds = corpus.current(chip, canon_version)
    fn = F.concat_ws(":", "image_id", F.col("entry").cast("string"))
    forms = graph.settled(analysis["forms"].select("fn", "digest", "call_targets", "instruction_count"))
    own = analysis["parsed"].where(F.col("chip") == chip).select("image_id").distinct()
    functions = analysis["boundaries"].join(own, "image_id", "left_semi").withColumnRenamed("confidence", "boundary_confidence").withColumn("fn", fn).join(forms, "fn", "left")
    signatures = match.current_signatures(corpus.functions(), builds, chip, canon_version, forms.select("digest"))
    hits = match.preferred(signatures).join(match.with_builds(match.signature_lists(signatures), builds), "digest", "left")
    hits = graph.settled(hits.withColumn("sources", F.array_sort(F.array_distinct(F.transform(F.filter("signatures", lambda s: s["name"] == F.col("name")), lambda s: s["label"])))))
    lists = hits.select("digest", "ambiguous_with", "shared_components", "source_ids", "signatures", "sources")
    found = match.identify(functions, hits.select("digest", "name", "component", "origin", "confidence", F.size("ambiguous_with").alias("rivals"), F.size("shared_components").alias("shares"), F.size("source_ids").alias("builds")))
    entries = functions.select(F.col("fn").alias("entry"))
    calls = functions.select("image_id", F.col("fn").alias("src"), F.explode("call_targets").alias("to")).select("src", F.concat_ws(":", "image_id", F.col("to").cast("string")).alias("dst"))
    degrees = graph.degrees(calls, entries).withColumnRenamed("entry", "fn")
    callees = graph.known_callees(graph.known_edges(calls, entries), found.where("identified").select(F.col("fn").alias("entry"), "name")).withColumnRenamed("src", "fn").withColumnRenamed("callees", "callees_known")
    found = graph.settled(found.join(degrees, "fn").join(callees, "fn", "left"))  # all tables below are read from it
    empty = F.array().cast("array<string>")
    some = lambda count: F.when(F.col(count) > 0, F.array(F.lit(""))).otherwise(empty)
    members = layout.anchors(found.select(F.col("image_id").alias("image"), F.col("entry").alias("vaddr"), "size", "component", "identified", some("rivals").alias("ambiguous_with"), some("shares").alias("shared_components")))
    found = found.drop("shares")
    likely = layout.likely_components(members).select(F.col("image").alias("image_id"), F.col("vaddr").alias("entry"), "likely_component")
    coverage = layout.coverage(members)
    matched = F.col("matched") / F.col("total")
    doubts = recover.cautions(analysis["boundaries"], analysis["segments"]).withColumnRenamed("image_id", "image")
    parsing = analysis["parsed"].select(F.col("image_id").alias("image"), F.col("warnings").alias("parsing")).dropDuplicates(["image"])
    warnings = coverage.join(doubts, "image", "left").join(parsing, "image", "left").select("image", F.concat(F.coalesce("parsing", empty), F.coalesce("cautions", empty), F.array_compact(F.array(F.when(F.col("matched") == 0, F.lit("nothing was identified")), F.when(matched < LOW_COVERAGE, F.lit("less than half of the functions were identified"))))).alias("warnings"))
    return {
        "identified": found.where("identified").join(lists, "digest", "left").orderBy("image_id", "entry"),
        "unidentified": found.where("NOT identified").join(lists, "digest", "left").join(likely, ["image_id", "entry"], "left").orderBy("image_id", F.desc("size"), F.desc("in_degree"), "entry"),
        "regions": layout.regions(members),
        "coverage": coverage,
        "by_component": layout.by_component(members),
        "warnings": warnings,
        "builds": builds,
        "labels": builds.select("build_id", "idf_version", describe_build(F.col("idf_version"), F.col("config_name"), F.col("config_hash")).alias("label")),
        "summary": coverage.join(versions_of(found, hits, builds), "image", "left").withColumn("versions", F.coalesce("versions", F.lit(0))),
    }


def versions_of(found: DataFrame, hits: DataFrame, builds: DataFrame) -> DataFrame:
    """(image, versions): how many versions the identified functions of an image come from. Builds become versions digest by digest, not function by function."""
    sources = hits.select("digest", F.explode("source_ids").alias("build_id")).join(builds.select("build_id", "idf_version"), "build_id").select("digest", "idf_version").distinct()
    rows = found.where("identified").select(F.col("image_id").alias("image"), "digest").distinct().join(sources, "digest")
    return rows.groupBy("image").agg(F.countDistinct("idf_version").alias("versions"))
