"""From chunks to generated statements, and blocks of writes in order."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import NO_SCHEMA, ascii_fold, fill_prompt, is_blank, or_default, pipe_join, pipe_split, quote_escape
from loomgraph.operators.graph import Graph
from loomgraph.operators.introspect import schema_text
from loomgraph.plans.replies import Model, ask
from loomgraph.plans.retrieval import TextModel
from loomgraph.sources.scratch import written

#: The deterministic extractor's rules: sentences "A is a Label." and "A kind B.", with names of letters, digits and underscores.
IS_A, RELATION = r"(\w+) is an? (\w+)\.", r"(\w+) ([A-Z][A-Z0-9_]*) (\w+)\."


def extracted(chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A statement list for each chunk: nodes for "A is a Label.", edges for "A KIND B." between names that the chunk declares.

    Blank chunks are left out; a chunk without any such sentence has an empty text. Everything is a JVM expression.
    """
    full = chunks.where(~is_blank(text)).select(key, F.col(text).alias("t"))
    t = ascii_fold("t")
    names, kinds = F.regexp_extract_all(t, F.lit(IS_A), 1), F.regexp_extract_all(t, F.lit(IS_A), 2)
    nodes = F.zip_with(names, kinds, lambda a, k: F.concat(F.lit("MERGE ("), F.lower(a), F.lit(":"), k, F.lit(" {title: '"), quote_escape(a), F.lit("', context: '"), k, F.lit("'})")))
    ends = F.arrays_zip(F.regexp_extract_all(t, F.lit(RELATION), 1).alias("a"), F.regexp_extract_all(t, F.lit(RELATION), 2).alias("k"), F.regexp_extract_all(t, F.lit(RELATION), 3).alias("b"))
    known = F.filter(ends, lambda e: F.array_contains(names, e["a"]) & F.array_contains(names, e["b"]))
    edges = F.transform(known, lambda e: F.concat(F.lit("MERGE ("), F.lower(e["a"]), F.lit(")-[:"), e["k"], F.lit("]->("), F.lower(e["b"]), F.lit(")")))
    return full.select(key, pipe_join(F.concat(F.array_distinct(nodes), F.array_distinct(edges))).alias("statements"))


def extracted_by_model(chunks: DataFrame, template: str, model: TextModel | Model, schema: str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
    """As extracted, by a model's replies to a template with {context} and {schema_context}; a null reply (a failure) is an empty list. The
    model is asked once for each chunk, whatever reads its statements."""
    full = chunks.where(~is_blank(text)).select(key, text)
    prompt = fill_prompt(template, context=F.col(text), schema_context=or_default(F.lit(schema), NO_SCHEMA))
    return ask(full, prompt, model, "reply_").select(key, pipe_join(pipe_split(F.coalesce("reply_", F.lit("")))).alias("statements"))


def described_schema(graph: Graph, template: str, model: TextModel | Model | None) -> str:
    """A model's summary of the schema, as its reply to a template with {schema}; the schema's own text where no model is configured, or
    where its reply is null or blank."""
    text = schema_text(graph)
    if model is None:
        return text
    row = SparkSession.active().createDataFrame([(text,)], "schema string")
    reply = ask(row, fill_prompt(template, schema="schema"), model, "reply_").select(F.when(~is_blank("reply_"), F.col("reply_"))).first()[0]
    return text if reply is None else reply


def load_blocks(graph: Graph, blocks: list[Callable[[Graph], Graph]]) -> tuple[Graph, list[str]]:
    """Runs blocks of writes in order. What a block has changed is written to the work folder before the next one starts; a block that
    fails is reported, writes nothing, and doesn't stop the others."""
    report = []
    for i, block in enumerate(blocks, 1):
        try:
            new = block(graph)
            graph = Graph(_kept(graph.nodes, new.nodes, f"block-{i}"), _kept(graph.edges, new.edges, f"block-{i}"))
            report.append(f"OK block {i}/{len(blocks)}")
        except Exception as e:
            report.append(f"ERROR block {i}/{len(blocks)}: {e}")
    return graph, report


def _kept(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], name: str) -> dict[str, DataFrame]:
    return {k: new[k] if k in old and new[k] is old[k] else written(new[k], name) for k in new}


def choose(models: dict[str, TextModel], order: tuple[str, ...]) -> TextModel | None:
    """The first configured model of an order of preference, or none."""
    return next((models[name] for name in order if name in models), None)
