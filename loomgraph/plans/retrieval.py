"""The question path: guard, plan, retrieve, envelope. Questions are rows; text models are pluggable columns or Arrow functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import NO_HISTORY, fill_prompt, guard_decision, or_default
from loomgraph.operators.graph import DEFAULT_LIMIT
from loomgraph.plans.replies import Model, ask
from loomgraph.sources.scratch import settled, written

#: The sentences that users see.
REFUSAL = "W bazie danych nie ma informacji"
NO_MODEL, APOLOGY = "Dane z grafu wiedzy: ", "Przepraszam, nie mogłem uzyskać odpowiedzi z bazy wiedzy. Błąd: "

#: A text model: from a column of prompts to a column of replies. Expressions stay in the JVM; a pandas UDF may call a real model. Where a
#: Model is given instead, its replies are kept and read again.
TextModel = Callable[[Column], Column]


def keyword_guard(*keywords: str) -> TextModel:
    """The deterministic guard: any keyword in the question passes it."""

    def model(question: Column) -> Column:
        found = F.lit(False)
        for k in keywords:
            found = found | F.contains(F.lower(question), F.lit(k.lower()))
        return F.when(found, F.lit("generate_cypher")).otherwise(F.lit("end"))

    return model


def routed(questions: DataFrame, guard: TextModel | Model, question: str = "question") -> DataFrame:
    """Adds guardrail_decision; a null question ends. The guard is asked once for each question, whatever reads its decisions."""
    asked = ask(questions, F.coalesce(F.col(question), F.lit("")), guard, "guard_reply")
    return asked.withColumn("guardrail_decision", guard_decision("guard_reply")).drop("guard_reply")


def refusals(routed_questions: DataFrame) -> DataFrame:
    """The refusal branch: a fixed sentence, an empty context, no query."""
    rows = routed_questions.where("guardrail_decision = 'end'")
    return rows.withColumns({"answer": F.lit(REFUSAL), "context": F.lit("[]"), "query": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})


def context_json(rows: DataFrame, key: str, columns: list[str], order: list[Column], limit: int = DEFAULT_LIMIT, alias: str = "context") -> DataFrame:
    """Each key's first rows as a JSON array of objects; nulls and characters beyond ASCII stay."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    few = rows.withColumn("turn", turn).where(F.col("turn") <= limit)
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.struct(*columns).alias("row"))))
    return few.groupBy(key).agg(F.to_json(F.transform(ordered, lambda r: r["row"]), {"ignoreNullFields": "false"}).alias(alias))


def envelope(rows: DataFrame) -> DataFrame:
    """answer, and metadata of guardrail_decision, query and context."""
    return rows.withColumn("metadata", F.struct("guardrail_decision", "query", "context"))


@dataclass(frozen=True)
class Plan:
    """A deterministic planner: pattern takes the key out of a question; rows holds what the graph has for a key.

    Each key's first rows are ranked and made JSON once, whatever the number of questions about it; then all questions meet them in one
    join on the key. needs: labels and types without which the plan has nothing to say.
    """

    pattern: str
    rows: DataFrame
    key: str
    columns: list[str]
    order: list[Column]
    query: str
    limit: int = DEFAULT_LIMIT
    needs: tuple[str, ...] = ()

    def fits(self, question: str) -> Column:
        return F.regexp_extract(question, self.pattern, 1) != ""

    def retrieve(self, questions: DataFrame, qid: str, question: str) -> DataFrame:
        asked = questions.withColumn("asked", F.lower(F.regexp_extract(question, self.pattern, 1)))
        wanted = asked.select("asked").distinct()
        rows = self.rows.withColumn("asked", F.lower(self.key)).join(wanted, "asked", "left_semi")
        found = context_json(rows, "asked", self.columns, self.order, self.limit)
        text = F.replace(F.lit(self.query), F.lit("{key}"), F.col("asked"))
        error = F.when(F.col("asked") == "", F.lit(NO_PLAN))
        return asked.join(found, "asked", "left").withColumns({"context": F.coalesce("context", F.lit("[]")), "query": F.coalesce(error, text), "error": error}).drop("asked")


NO_PLAN = "Query failed: no pattern fits the question"


@dataclass(frozen=True)
class Plans:
    """Several plans: a question goes to the first that fits it, of those for which the schema (labels and types) has all they need."""

    plans: tuple[Plan, ...]
    schema: frozenset[str] | None = None

    def retrieve(self, questions: DataFrame, qid: str, question: str) -> DataFrame:
        usable = [p for p in self.plans if self.schema is None or set(p.needs) <= self.schema]
        which = F.lit(-1)
        for i, p in reversed(list(enumerate(usable))):
            which = F.when(p.fits(question), F.lit(i)).otherwise(which)
        dealt = questions.withColumn("plan", which)
        out = failed(dealt.where("plan = -1").drop("plan"), NO_PLAN)
        for i, p in enumerate(usable):
            out = out.unionByName(p.retrieve(dealt.where(F.col("plan") == i).drop("plan"), qid, question))
        return out


def failed(questions: DataFrame, error: str) -> DataFrame:
    """An empty context, and the error in place of the query."""
    return questions.withColumns({"context": F.lit("[]"), "query": F.lit(error), "error": F.lit(error)})


@dataclass(frozen=True)
class Guarded:
    """Runs a planner's retrieval at once, into the work folder. If that fails, every question has an empty context and the error."""

    plan: Plan | Plans

    def retrieve(self, questions: DataFrame, qid: str, question: str) -> DataFrame:
        try:
            return written(self.plan.retrieve(questions, qid, question), "retrieved")
        except Exception as e:
            reason = next(iter(str(e).strip().splitlines()), type(e).__name__)
            return failed(questions, f"Query failed: {reason}")


def no_model_answer(question: Column, data: Column, past: Column) -> Column:
    """The answer where no model is configured."""
    return F.concat(F.lit(NO_MODEL), data)


@dataclass(frozen=True)
class ModelAnswer:
    """The answer of a model to a template with {history}, {user_input} and {data}."""

    template: str
    model: TextModel | Model

    def prompt(self, question: Column, data: Column, past: Column) -> Column:
        return fill_prompt(self.template, history=or_default(past, NO_HISTORY), user_input=question, data=data)

    def __call__(self, question: Column, data: Column, past: Column) -> Column:
        return self.model(self.prompt(question, data, past))


def model_answer(template: str, model: TextModel | Model) -> ModelAnswer:
    return ModelAnswer(template, model)


def answer_questions(questions: DataFrame, guard: TextModel, plan: Plan | Plans | Guarded, qid: str = "qid", question: str = "question", final=no_model_answer, past: str | None = None) -> DataFrame:
    """All questions: refused or retrieved, then answered. Rows: the input's columns, answer, context, query, error, metadata.

    Each question gives one row, also of models that answer differently each time: a model's replies are settled before rows part."""
    rows = routed(questions, guard, question)
    passed = plan.retrieve(rows.where("guardrail_decision = 'generate_cypher'"), qid, question)
    before = F.col(past) if past else F.lit(None).cast("string")
    if isinstance(final, ModelAnswer):
        passed = ask(passed, final.prompt(F.col(question), F.col("context"), before), final.model, "answer")
    else:
        passed = settled(passed.withColumn("answer", final(F.col(question), F.col("context"), before)), "answers")
    return envelope(passed.unionByName(refusals(rows)))


def mermaid(edges: set[tuple[str, str, str | None]]) -> str:
    """A diagram of states: edges of from, to and a condition, in order."""
    lines = ["graph TD"]
    for a, b, condition in sorted(edges, key=lambda e: (e[0], e[1], e[2] or "")):
        lines.append(f"    {a} -->|{condition}| {b}" if condition else f"    {a} --> {b}")
    return "\n".join(lines)


#: The states of the question path.
STATES = {("START", "guard", None), ("guard", "plan", "generate_cypher"), ("guard", "refuse", "end"), ("plan", "retrieve", None), ("retrieve", "END", None), ("refuse", "END", None)}
