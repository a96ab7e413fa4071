"""Canonical forms: a function's instructions as position-independent text, with a digest, in Column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlake.functions.scalar import NARROW, PADDING, displacement, fold_mnemonic, operand_number, tagged_digest

VERSION = 3
TAG = f"canonical-form-v{VERSION}"  # configurable, so that corpora made with another tag stay comparable
LITERAL, CALL = "LIT", "CALL"

SCHEMA = "fn string, addr long, size int, mnemonic string, operands array<string>, cls string, target long, literal_value long, target_symbol string, literal_text string"


def strip_trailing_padding(rows: DataFrame) -> DataFrame:
    """Without the padding after each function's last real instruction; one row is kept if all are padding."""
    whole = Window.partitionBy("fn")
    real = F.max(F.when(~F.lower("mnemonic").isin(PADDING), F.col("addr"))).over(whole)
    return rows.withColumn("_end", F.coalesce(real, F.min("addr").over(whole))).where("addr <= _end").drop("_end")


def _last_operand(ops: Column, new: Column) -> Column:
    return F.when(F.size(ops) > 0, F.concat(F.slice(ops, F.lit(1), F.size(ops) - 1), F.array(new))).otherwise(ops)


def lines(rows: DataFrame) -> DataFrame:
    """Each instruction with its canonical line (null if it leaves none) and raw line, and what it adds to the form.

    Two windows replace a walk with registers in hand: the previous event on the same register tells what a call through
    it reads, and the previous line of the function tells whether the load stands right before the call.
    """
    df = strip_trailing_padding(rows)
    folded, ops, cls = fold_mnemonic(F.col("mnemonic")), F.col("operands"), F.col("cls")
    move = (folded == "or") & (F.size(ops) == 3) & (F.get(ops, F.lit(1)) == F.get(ops, F.lit(2)))
    df = df.withColumns({"m": F.when(move, "mov").otherwise(folded), "o": F.when(move, F.slice(ops, 1, 2)).otherwise(ops), "reg": F.get(ops, F.lit(0))})
    other = ~cls.isin("literal_load", "call", "call_indirect", "branch", "jump", "loop")
    hop = cls.isin("branch", "jump", "loop") & F.col("target").isNotNull()
    masked = (
        F.when(cls == "literal_load", _last_operand(F.col("o"), F.lit(LITERAL)))
        .when(cls == "call", _last_operand(F.col("o"), F.lit(CALL)))
        .when(hop, _last_operand(F.col("o"), displacement(F.col("target"), F.col("addr"))))
        .otherwise(F.col("o"))
    )
    stack = (F.size("o") == 2) & (F.get("o", F.lit(0)) == "a1") & (F.get("o", F.lit(1)) == "a1")
    df = df.withColumns({"masked": masked, "nop": (F.col("m") == "nop") | ((F.col("m") == "mov") & stack), "other": other})
    # the previous event on the register: a load, a call through it, or any other first operand
    event = F.col("reg").isNotNull() & (cls.isin("literal_load", "call_indirect") | F.col("other"))
    by_reg = Window.partitionBy("fn", F.when(event, F.col("reg")), event).orderBy("addr")
    df = df.withColumns({"prev_cls": F.when(event, F.lag("cls").over(by_reg)), "prev_value": F.when(event, F.lag("literal_value").over(by_reg)), "prev_addr": F.when(event, F.lag("addr").over(by_reg))})
    by_line = Window.partitionBy("fn", "nop").orderBy("addr")
    df = df.withColumn("line_addr", F.when(~F.col("nop"), F.lag("addr").over(by_line)))
    through = (cls == "call_indirect") & (F.col("prev_cls") == "literal_load")
    df = df.withColumn("collapsed", F.coalesce(through & (F.col("line_addr") == F.col("prev_addr")), F.lit(False)))
    df = df.withColumn("resolved", F.when(through, F.col("prev_value")))
    absorbed = F.coalesce(F.lead("collapsed").over(by_line), F.lit(False)) & ~F.col("nop") & (cls == "literal_load")
    width = F.substring("mnemonic", 6, 8)
    text = F.when(F.col("collapsed"), F.concat(F.lit("call"), F.when(width == "", "8").otherwise(width), F.lit(f" {CALL}"))).otherwise(F.btrim(F.concat_ws(" ", F.col("m"), F.array_join("masked", " "))))
    hexed = lambda c: F.format_string("0x%08x", c)
    raw_ops = F.when((cls == "literal_load") & F.col("literal_value").isNotNull(), _last_operand(ops, hexed(F.col("literal_value")))).when(F.col("resolved").isNotNull(), F.array(hexed(F.col("resolved")))).otherwise(ops)
    return df.withColumns(
        {
            "line": F.when(~F.col("nop") & ~absorbed, text),
            "raw": F.btrim(F.concat_ws(" ", F.format_string("%08x", F.col("addr")), F.col("mnemonic"), F.array_join(raw_ops, " "))),
            "edge": F.when(cls == "call", F.coalesce("target_symbol", F.lit(CALL))).when((cls == "call_indirect") & (F.col("resolved").isNotNull() | F.col("collapsed")), F.lit(CALL)),
            "call_target": F.when(cls == "call", F.col("target")).otherwise(F.col("resolved")),
            "unresolved": (cls == "call_indirect") & F.col("resolved").isNull() & ~F.col("collapsed"),
            "numbers": F.when(F.col("other"), F.filter(F.transform("o", operand_number), lambda x: x.isNotNull())),
        }
    )


def forms(rows: DataFrame, tag: str = TAG, keep: tuple[str, ...] = ()) -> DataFrame:
    """(fn, canonical_text, digest, raw_text, ...): one row a function that has instructions.

    Order is by address throughout. Strings and literals are recorded, never hashed. ``keep``: columns, the same in all rows of a function,
    that stay. Functions are dealt to as many tasks as there are shuffle partitions, as the windows cost far more than their bytes tell the planner.
    """
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fn")

    def ordered(value: str, condition: str | None = None):
        item = F.struct("addr", F.col(value).alias("v"))
        some = F.collect_list(F.when(F.expr(condition) if condition else F.col(value).isNotNull(), item))
        return F.transform(F.array_sort(some), lambda x: x["v"])

    df = lines(rows).groupBy("fn").agg(
        F.array_join(ordered("line"), "\n").alias("canonical_text"),
        F.array_join(ordered("raw"), "\n").alias("raw_text"),
        F.sum("size").cast("long").alias("size"),
        F.count("*").alias("instruction_count"),
        ordered("edge").alias("call_edges"),
        ordered("call_target").alias("call_targets"),
        F.count_if("unresolved").alias("indirect_calls"),
        F.count_if(F.col("cls") == "branch").alias("branch_count"),
        ordered("literal_value", "cls = 'literal_load' AND literal_value IS NOT NULL").alias("literals"),
        F.flatten(ordered("numbers")).alias("immediates"),
        ordered("literal_text", "literal_text <> ''").alias("strings"),
        F.when((F.min_by("cls", "addr") == "entry") | F.bool_or((F.col("cls") == "return") & F.col("mnemonic").startswith("retw")), "windowed").otherwise("call0").alias("prologue"),
        *[F.first(c).alias(c) for c in keep],
    )
    return df.withColumn("digest", tagged_digest(F.col("canonical_text"), tag))


__all__ = ["NARROW", "SCHEMA", "forms", "lines", "strip_trailing_padding"]
