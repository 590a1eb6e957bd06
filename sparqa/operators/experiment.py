"""Experiment grid, stage selection, tagging, limits and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparqa.operators import answer as ans
from sparqa.operators.answerstore import answers_once
from sparqa.operators.collection import scratch_path
from sparqa.operators.embed import Embedder, hash_embedder
from sparqa.plans.fixtures import EXPERIMENTS, config_array
from sparqa.sources.results import build_output_path

EXPERIMENT_NAMES = [e[0] for e in EXPERIMENTS]
# The stage choices.
ACTIONS = ["all", "generate", "bert", "ragas"]


def check_experiment(name: str) -> list[str]:
    """``all`` or one known name; anything else is an error."""
    if name == "all":
        return list(EXPERIMENT_NAMES)
    if name not in EXPERIMENT_NAMES:
        raise ValueError(f"Unknown experiment: {name}")
    return [name]


def check_action(action: str) -> dict[str, bool]:
    """Which stages run for an action."""
    if action not in ACTIONS:
        raise ValueError(f"Unknown action: {action}. Choose from {ACTIONS}.")
    return {"generate": action in ("all", "generate"), "bert": action in ("all", "bert"),
            "ragas": action in ("all", "ragas")}


# Fixed value: what a missing question or answer of a fresh dataset reads as.
MISSING_QA = "nan"


def fill_missing_text(qa: DataFrame) -> DataFrame:
    """M1: a missing question or answer becomes the text ``nan``; no row is dropped."""
    return qa.withColumns({c: F.coalesce(F.col(c), F.lit(MISSING_QA)) for c in ("question", "answer") if c in qa.columns})


def grid(questions: DataFrame, experiment: str = "all") -> DataFrame:
    """Every question under every selected config (explode of a literal, no join)."""
    names = check_experiment(experiment)
    g = questions.select("*", F.explode(config_array()).alias("_cfg")).select(
        *questions.columns, "_cfg.ord", "_cfg.experiment", "_cfg.generator_model", "_cfg.use_rag",
        "_cfg.output_suffix")
    return g.where(F.col("experiment").isin(names))


def generate_grid(qa: DataFrame, points: DataFrame | None, experiment: str = "all", k: int = 3,
                  embedder: Embedder = hash_embedder, responder=None,
                  responders: dict | None = None, cut: int = ans.CONTEXT_CUT,
                  factories: dict | None = None, store: str | None = None) -> DataFrame:
    """X3 + X5 + G10: the QA rows (``row_id, question, answer``) under the selected configs.

    Retrieval runs once per distinct question text and is shared by the RAG configs (it does not depend
    on the model); every grid row is then prompted and answered by its own model:
    ``responders`` maps ``generator_model`` to a batch responder (``responder`` = one for
    all models; neither = the native stand-in); ``factories`` build them once per task. With ``store`` (a shared folder) every
    answer is in the answer store before this returns, and no distinct prompt is asked twice, in later runs either.
    Plain rows get ``[]`` contexts; missing questions and answers are filled first (M1).
    """
    names = check_experiment(experiment)
    qa = fill_missing_text(qa)
    rag_needed = any(r for n, _, r, _ in EXPERIMENTS if n in names)
    empty = F.array().cast("array<string>")
    if rag_needed:
        asked = qa.withColumn("_q", F.md5("question"))
        hits = ans.retrieve(asked.select("_q", "question").dropDuplicates(["_q"]), points, k, "_q", embedder=embedder)
        ctx = ans.contexts_by_question(hits, "_q", out_col="_ctx")
        base = asked.join(ctx, "_q", "left").drop("_q")
    else:
        base = qa.withColumn("_ctx", F.lit(None).cast("array<string>"))
    g = base.select("*", F.explode(config_array()).alias("_cfg")).where(F.col("_cfg.experiment").isin(names))
    g = g.select(
        *qa.columns, F.col("_cfg.experiment").alias("experiment"),
        F.col("_cfg.generator_model").alias("generator_model"), F.col("_cfg.use_rag").alias("use_rag"),
        F.when(F.col("_cfg.use_rag"), F.coalesce("_ctx", empty)).otherwise(empty).alias("retrieved_contexts"))
    if responder is not None and responders is None:
        responders = {m: responder for _, m, _, _ in EXPERIMENTS}
    if responders is None and factories is None:
        return g.withColumn("generated_answer", ans.standin_answer("retrieved_contexts")) \
                .select(*qa.columns, "experiment", "generator_model", "use_rag", "generated_answer",
                        "retrieved_contexts")
    prompted = g.withColumn("prompt", ans.build_prompt(
        "question", ans.build_context("retrieved_contexts", cut), F.col("use_rag")))
    if store is not None:
        prompted.write.parquet(path := scratch_path(qa.sparkSession, "prompted"))  # retrieval runs once for store and rows
        out = answers_once(qa.sparkSession.read.parquet(path), store, responders, factories=factories)
    else:
        out = ans.answer_by_model(prompted, responders or {}, factories=factories)
    return out.select(*qa.columns, "experiment", "generator_model", "use_rag", "generated_answer",
                      "retrieved_contexts")


def run_stages(action: str, *, generate=None, load=None, experiment: str = "all",
               judge=None, keys: list[str] | None = None) -> DataFrame:
    """Run the stages an action selects.

    ``generate``: () -> generated DataFrame (the ``generate`` stage); ``load``: () -> a
    saved generated table (S7), used when the action does not generate. ``bert`` adds the
    token-matching scores (T1), ``ragas`` the judge metrics (T4-T9; native judge unless a
    ``judge`` function is given, attached by ``keys``).
    """
    from sparqa.operators.judge import attach_metrics, native_judge, require_contexts, run_judge
    from sparqa.operators.tokenmatch import bertscore

    stages = check_action(action)
    names = check_experiment(experiment)
    if stages["generate"]:
        df = generate()
    else:
        df = load()
        if "experiment" not in df.columns:
            df = df.withColumn("experiment", F.lit(names[0]))
        if "use_rag" not in df.columns:
            rag_of = {n: r for n, _, r, _ in EXPERIMENTS}
            df = df.withColumn("use_rag", F.coalesce(
                F.element_at(F.create_map(*[x for n in rag_of for x in (F.lit(n), F.lit(rag_of[n]))]),
                             F.col("experiment")), F.lit(True)))
    if stages["bert"]:
        df = bertscore(df)
    if stages["ragas"]:
        require_contexts(df, any(r for n, _, r, _ in EXPERIMENTS if n in names))  # T12
        if judge is None:
            df = native_judge(df, use_rag="use_rag")
        else:
            keys = keys or ["row_id", "experiment"]
            rag = run_judge(df.where(F.col("use_rag")), keys, judge, use_rag=True)
            plain = run_judge(df.where(~F.col("use_rag")), keys, judge, use_rag=False)
            df = attach_metrics(df, rag.unionByName(plain, allowMissingColumns=True), keys)
    return df


def run_stages_saved(action: str, path: str, qa: DataFrame, points: DataFrame | None = None, *, experiment: str = "all", config: dict | None = None,
                     k: int = 3, embedder: Embedder = hash_embedder, responders: dict | None = None, factories: dict | None = None,
                     judge=None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """X4 with every stage written before the next reads it: answers are generated once, and a run that died goes on where
    it stopped.

    ``path``: the run's folder (shared). ``config`` names what a digest cannot see: models, judge, collection version. The
    stages of ``action`` run per experiment, those committed for the same data and configuration do not. ``bert`` and ``ragas`` alone build on
    what ``generate`` committed and run it where it is missing. Returns the rows and the (stage, experiment) pairs that ran.
    """
    from sparqa.operators.judge import attach_metrics, native_judge, run_judge
    from sparqa.operators.staged import run_resumable
    from sparqa.operators.tokenmatch import bertscore

    wanted = check_action(action)
    names = check_experiment(experiment)
    spark = qa.sparkSession

    def generate(todo: list[str]) -> DataFrame:
        store = f"{path.rstrip('/')}/store" if responders or factories else None
        parts = [generate_grid(qa, points, e, k, embedder, responders=responders, factories=factories, store=store) for e in todo] if len(todo) < len(names) else [
            generate_grid(qa, points, experiment, k, embedder, responders=responders, factories=factories, store=store)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def ragas(df: DataFrame) -> DataFrame:
        if judge is None:
            return native_judge(df, use_rag="use_rag")
        keys = ["row_id", "experiment"]
        rag = run_judge(df.where(F.col("use_rag")), keys, judge, use_rag=True)
        plain = run_judge(df.where(~F.col("use_rag")), keys, judge, use_rag=False)
        return attach_metrics(df, rag.unionByName(plain, allowMissingColumns=True), keys)
    stages = [("generate", generate)] + [(n, f) for n, f in (("bert", bertscore), ("ragas", ragas)) if wanted[n]]
    return run_resumable(spark, path, stages, names, qa, {"k": k, "cut": ans.CONTEXT_CUT, "rag": ans.RAG_TEMPLATE, "plain": ans.PLAIN_TEMPLATE, **(config or {})})


def tag_results(df: DataFrame, experiment: str) -> DataFrame:
    """X5 on reload: add ``experiment`` only when the column is absent."""
    if "experiment" in df.columns:
        return df
    return df.withColumn("experiment", F.lit(experiment))


# Splitters drawn in a pass, and keys read back once a bracket holds this few rows. Neither
# changes the result, only the number of passes.
_SPLITTERS = 63
_LEAF_ROWS = 4096


def _key_literal(row, schema) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in schema.fields])


def _cut(keys: DataFrame, n: int):
    """(key of the last row kept, equal rows kept, equal rows) in ascending order; None = keep all, () = keep none.

    Passes count rows between splitters drawn at random and go on inside the bracket that holds the
    rank: one aggregate a pass, and only splitters and bracket totals reach the driver.
    """
    schema, lo, hi, want = keys.schema["_k"].dataType, None, None, n if n > 0 else None
    while True:
        part = keys
        if lo is not None:
            part = part.where(F.col("_k") > _key_literal(lo, schema))
        if hi is not None:
            part = part.where(F.col("_k") <= _key_literal(hi, schema))
        split = part.orderBy(F.rand()).limit(_SPLITTERS).distinct().orderBy("_k").collect()
        marks = F.array(*[_key_literal(r["_k"], schema) for r in split])
        # even: between two splitters; odd: equal to one, so a hot key is a bracket of its own
        bucket = (2 * F.size(F.filter(marks, lambda s: s < F.col("_k"))) + F.exists(marks, lambda s: s == F.col("_k")).cast("int")
                  if split else F.lit(0))
        brackets = part.groupBy(bucket.alias("_b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_k").alias("first"), F.max("_k").alias("last")).orderBy("_b").collect()
        total = sum(b["n"] for b in brackets)
        if want is None:  # all but the last |n| rows
            want = total + n
        if want <= 0:
            return ()
        if want > total or want == total and hi is None:
            return None
        for b in brackets:
            if want <= b["n"]:
                break
            want -= b["n"]
        if b["first"] == b["last"]:
            return b["last"], want, b["n"]
        if b["n"] <= _LEAF_ROWS:
            inside = part.where((F.col("_k") >= _key_literal(b["first"], schema)) & (F.col("_k") <= _key_literal(b["last"], schema)))
            rows = [r["_k"] for r in inside.orderBy("_k").limit(b["n"]).collect()]
            key = rows[want - 1]
            return key, sum(r == key for r in rows[:want]), sum(r == key for r in rows)
        if b["_b"]:
            lo = split[b["_b"] // 2 - 1]["_k"]
        hi = b["last"]


def limit_rows(df: DataFrame, n: int | None, order_col: str = "row_id") -> DataFrame:
    """X6 (``head`` semantics): None -> all, 0 -> none, n > 0 -> the first n rows,
    n < 0 -> all but the last |n|.

    Order: ``order_col`` ascending, NULL first, ties by a hash of the whole row; exactly the
    asked number of rows at any size (rows that tie in both are alike). The key of the last row kept
    is found by counting, then rows are filtered, so kept rows never pass through one task.
    The keys are written once and counted from there; ``df`` itself is read twice and must be the same in both.
    """
    if n is None:
        return df
    if n == 0:
        return df.limit(0)
    key = F.struct(F.col(order_col).alias("v"), F.xxhash64(*[F.col(c) for c in df.columns]).alias("h"))
    keys = df.select(key.alias("_k"))
    keys.write.parquet(path := scratch_path(df.sparkSession, "limit-keys"))
    cut = _cut(df.sparkSession.read.schema(keys.schema).parquet(path), n)
    if cut is None:
        return df
    if not cut:
        return df.limit(0)
    last, keep, alike = cut
    mark = _key_literal(last, df.select(key.alias("_k")).schema["_k"].dataType)
    if keep == alike:
        return df.where(key <= mark)
    return df.where(key < mark).unionByName(df.where(key == mark).limit(keep))


def run_summary(configs: DataFrame, base_output: str, action: str) -> DataFrame:
    """One row per experiment: name, output path, action."""
    check_action(action)
    return configs.select(F.col("experiment"),
                          build_output_path(F.lit(base_output), F.col("output_suffix")).alias("output_path"),
                          F.lit(action).alias("action"))
