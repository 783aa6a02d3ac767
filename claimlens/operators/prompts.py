"""Prompts with evidence, and predictions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_label
from ..protocols import Generator, OverlapGenerator

# The prompt's parts and what stands for missing evidence.
HEADER = (
    "Classify the following claim into one of these categories:\n"
    "- SUPPORTS: The claim is supported by evidence\n"
    "- REFUTES: The claim is refuted by evidence\n"
    "- NOT ENOUGH INFO: There is not enough information to verify\n\n"
)
NOTHING_FOUND = "No evidence found."
EXAMPLES, CLAIM, EVIDENCE, LABEL = "Examples:\n\n", "Claim: ", "Evidence:\n", "Label:"
ITEM, SOURCE, RELEVANCE, UNKNOWN = "[Evidence ", "] (Source: ", ", Relevance: ", "Unknown"


def evidence_texts(hits: DataFrame, most: int = 5, claim: str = "claim_id") -> DataFrame:
    """One text of each claim's first hits: claim and evidence."""
    best = hits.where(F.col("rank") <= most).groupBy(claim).agg(F.array_sort(F.collect_list(F.struct("rank", "article_id", "score", "text"))).alias("h"))
    shown = F.transform("h", lambda x, i: F.concat(F.lit(ITEM), (i + 1).cast("string"), F.lit(SOURCE), F.coalesce(x["article_id"].cast("string"), F.lit(UNKNOWN)), F.lit(RELEVANCE), F.format_string("%.3f", x["score"]), F.lit(")\n"), F.coalesce(x["text"], F.lit(""))))
    return best.select(claim, F.array_join(shown, "\n\n").alias("evidence"))


def examples_text(examples: list[tuple[str, str]]) -> str:
    """Few-shot examples, (claim, label) each."""
    return EXAMPLES + "".join(f"{CLAIM}{c}\n{LABEL} {label}\n\n" for c, label in examples) if examples else ""


def prompt(claim: Column, evidence: Column | None = None, examples: list[tuple[str, str]] | None = None) -> Column:
    parts = [F.lit(HEADER + examples_text(examples or []) + CLAIM), claim, F.lit("\n\n")]
    if evidence is not None:
        parts += [F.lit(EVIDENCE), F.coalesce(evidence, F.lit(NOTHING_FOUND)), F.lit("\n\n")]
    return F.concat(*parts, F.lit(LABEL))


def generate(df: DataFrame, generator: Callable[[], Generator] = OverlapGenerator, column: str = "prompt", batch: int = 32) -> DataFrame:
    """Adds `response`, the model's answer to each prompt. A call that fails is made once more, after
    the model's `restart()` if it has one."""

    def rows(batches):
        model = generator()
        restart = getattr(model, "restart", lambda: None)
        for rb in batches:
            texts = rb.column(column).to_pylist()
            out = []
            for i in range(0, len(texts), batch):
                try:
                    out += model.generate(texts[i : i + batch])
                except Exception:
                    restart()
                    out += model.generate(texts[i : i + batch])
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(out, pa.string())], names=[*rb.schema.names, "response"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(rows, f"{schema}, response string")


def predict(claims: DataFrame, hits: DataFrame | None, generator: Callable[[], Generator] = OverlapGenerator, examples: list[tuple[str, str]] | None = None, most: int = 5) -> DataFrame:
    """claim_id, claim, any true label, prompt, response and predicted_label."""
    if hits is None:
        asked = claims.withColumn("prompt", prompt(F.col("claim"), None, examples))
    else:
        asked = claims.join(evidence_texts(hits, most), "claim_id", "left")
        asked = asked.withColumn("prompt", prompt(F.col("claim"), F.col("evidence"), examples)).drop("evidence")
    return generate(asked, generator).withColumn("predicted_label", parse_label(F.col("response")))


#: Generators by name: a temperature to a factory.
GENERATORS: dict[str, Callable[[float], Callable[[], Generator]]] = {"overlap": lambda temperature: OverlapGenerator}
