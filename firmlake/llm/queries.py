"""The queries opN_<name> and pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from firmlake.llm.language import op5_language
from firmlake.llm.media import op4_media
from firmlake.llm.mixing import OP1_SQL, op1_mixing
from firmlake.llm.pieces import op2_pieces
from firmlake.llm.scoring import op6_scoring
from firmlake.llm.secrets import op3_secrets
from firmlake.llm.simhash import op10_simhash
from firmlake.llm.suffixes import OP8_SQL, op8_suffixes
from firmlake.llm.toxicity import op7_toxicity
from firmlake.llm.vectors import OP9_SQL, op9_embeddings


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_mixing": op1_mixing,
        "op2_pieces": op2_pieces,
        "op3_secrets": op3_secrets,
        "op4_media": op4_media,
        "op5_language": op5_language,
        "op6_scoring": op6_scoring,
        "op7_toxicity": op7_toxicity,
        "op8_suffixes": op8_suffixes,
        "op9_embeddings": op9_embeddings,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op8_suffixes": OP8_SQL, "op9_embeddings": OP9_SQL}
