"""Report files of tuning, paired tests, flips and generated answers, and the folders they go to.

What is written here has a row for each run, benchmark or example, so it is made on the driver; files go through Spark's file systems.
"""

from __future__ import annotations

import json
import math
import re
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The names of benchmarks, whose items are under a root; other names are paths themselves.
BENCHMARKS = (
    "time_sensitive_qa", "menat_qa", "menat_qa_granularity", "menat_qa_counterfactual", "menat_qa_expand", "menat_qa_narrow", "ts_retriever", "temp_reason_l1",
    "temp_reason_l2", "temp_reason", "chronoqa", "temp_rag_eval",
)


def benchmark_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}" if name in BENCHMARKS else name


def slug(run_id: str) -> str:
    """A run's name as a file name."""
    return re.sub(r"[^A-Za-z0-9._+-]+", "_", run_id).strip("_") or "run"


def number(x: float | None, places: int = 4) -> str:
    return f"{x:.{places}f}" if x is not None and math.isfinite(x) else "-"


# How p-values are shown, and the limits and marks of significance.
def p_text(p: float | None) -> str:
    if p is None or not math.isfinite(p):
        return "-"
    return "0" if p == 0 else f"{p:.3e}" if p < 1e-4 else f"{p:.4g}"


def stars(p: float | None) -> str:
    """The marker of `text.p_marker`, of a number on the driver."""
    if p is None or math.isnan(p):
        return "n/a"
    return next((mark for limit, mark in ((0.001, "***"), (0.01, "**"), (0.05, "*")) if p < limit), "ns")


def rate_text(rows: int, seconds: float) -> str:
    """Rows a second, with thousands apart; "-" where no time has passed."""
    return f"{rows / seconds:,.0f} rows/s" if seconds > 0 else "-"


def duration_text(seconds: float) -> str:
    """Hours, minutes and seconds as Python shows them."""
    return str(timedelta(seconds=max(0, round(seconds))))


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _place(spark, path)
    fs.mkdirs(where)


def clear_folder(spark: SparkSession, path: str) -> None:
    """Removes what is in the folder, which stays; a folder that isn't there is made."""
    fs, where = _place(spark, path)
    if fs.exists(where):
        for found in fs.listStatus(where):
            fs.delete(found.getPath(), True)
    fs.mkdirs(where)


def put_text(spark: SparkSession, path: str, content: str) -> None:
    """One file, in place of another of its name."""
    fs, where = _place(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def put_json(spark: SparkSession, path: str, value) -> None:
    put_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))


def table(head: list[str], rows: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])


def tuned(rows: DataFrame, metric: str = "mrr") -> dict[str, dict]:
    """rows (benchmark, semantic_model, alpha, num_queries, metrics). Per benchmark the alpha with the best mean over models, the smaller among ties, and the grid."""
    kept = [c for c in ("mrr", "ndcg", "recall", "precision") if c in rows.columns]
    if metric not in kept:
        raise ValueError(f"no metric {metric!r}; there are {', '.join(kept)}")
    out: dict[str, dict] = {}
    for r in rows.orderBy("benchmark", "alpha", "semantic_model").collect():
        entry = out.setdefault(r["benchmark"], {"selection_metric": metric, "num_val_queries": r["num_queries"], "grid": {}})
        entry["grid"].setdefault(f"{r['alpha']:g}", {})[r["semantic_model"]] = {c: r[c] for c in kept}
    for entry in out.values():
        means = {a: sum(m[metric] for m in models.values()) / len(models) for a, models in entry["grid"].items()}
        best = max(means, key=lambda a: (means[a], -float(a)))
        entry |= {"mean_by_alpha": means, "best_alpha": float(best)}
    return out


def tuning_markdown(found: dict[str, dict]) -> str:
    alphas = sorted({a for e in found.values() for a in e["mean_by_alpha"]}, key=float)

    def cells(name: str, e: dict) -> list[str]:
        best = f"{e['best_alpha']:g}"
        shown = [f"**{number(e['mean_by_alpha'].get(a))}**" if a == best else number(e["mean_by_alpha"].get(a)) for a in alphas]
        return [name, *shown, best, str(e["num_val_queries"])]

    return "# Weights by validation split\n\n" + table(["Benchmark", *alphas, "Best", "Queries"], [cells(n, e) for n, e in found.items()]) + "\n"


def write_tuning(spark: SparkSession, found: dict[str, dict], path: str) -> None:
    """path.json with the grid and path.md with the means."""
    put_json(spark, f"{path}.json", found)
    put_text(spark, f"{path}.md", tuning_markdown(found))


def significance_markdown(rows: list[dict], benchmarks: list[str], baselines: list[str], metrics: list[str], top_k: int = 5, rounds: int = 10_000) -> str:
    """rows: benchmark, baseline, metric, n, mean_baseline, mean_hybrid, mean_diff, low, high, p_wilcoxon, p_t, wins, losses, ties."""
    label = {m: m.upper() if m == "mrr" else f"{m.upper()}@{top_k}" for m in metrics}
    order = {name: i for names in (benchmarks, baselines, metrics) for i, name in enumerate(names)}
    rows = sorted(rows, key=lambda r: tuple(order[r[c]] for c in ("benchmark", "baseline", "metric")))

    def change(r: dict) -> list[str]:
        return [number(r["mean_baseline"]), number(r["mean_hybrid"]), f"{r['mean_diff']:+.4f}"]

    parts = [f"# Paired tests of each baseline against its fusion\n\nTwo-sided Wilcoxon and t-tests; intervals of 95 % from {rounds:,} resamples."]
    for b in benchmarks:
        own = [r for r in rows if r["benchmark"] == b]
        if own:
            lines = [[r["baseline"], label[r["metric"]], *change(r), f"[{number(r['low'])}, {number(r['high'])}]", p_text(r["p_wilcoxon"]), p_text(r["p_t"]), f"{r['wins']} / {r['losses']} / {r['ties']}", stars(r["p_wilcoxon"])] for r in own]
            head = ["Baseline", "Metric", "Alone", "Fused", "Change", "Interval", "Wilcoxon p", "t-test p", "Win / loss / tie", "Mark"]
            parts.append(f"## {b} ({own[0]['n']} queries)\n\n" + table(head, lines))
    main = [[r["benchmark"], r["baseline"], *change(r), p_text(r["p_wilcoxon"]), stars(r["p_wilcoxon"])] for r in rows if r["metric"] == "mrr"]
    parts.append("## MRR\n\n" + table(["Benchmark", "Baseline", "Alone", "Fused", "Change", "Wilcoxon p", "Mark"], main))
    return "\n\n".join(parts) + "\n"


def flips_markdown(stats: dict, examples: list[dict], label: str, alpha: float, top_k: int = 5) -> str:
    """stats: n, and top1 and topk of both runs with how many queries each fixes and breaks. examples: question, years, ranks, and both runs' best texts."""
    n = stats["n"]

    def share(key: str) -> str:
        return f"{stats[key] / n if n else 0:.3f} ({stats[key]}/{n})"

    lines = [[f"Gold@{k}", share(f"semantic_{c}"), share(f"hybrid_{c}"), str(stats[f"fixed_{c}"]), str(stats[f"broken_{c}"])] for k, c in ((1, "top1"), (top_k, "topk"))]
    parts = [f"# {label} alone and fused at {alpha:g}, {n} queries", table(["Metric", "Alone", "Fused", "Fixed", "Broken"], lines)]
    for i, e in enumerate(examples, 1):
        ranks = f"Rank of gold among {e['num_candidates']}: alone {e['rank_semantic']}, temporal {e['rank_temporal']}, fused {e['rank_hybrid']}."
        lists = [f"{name}:\n\n" + "\n".join(f"- {t}" for t in e[c][:top_k]) for name, c in (("Alone", "semantic_best"), ("Fused", "hybrid_best"))]
        parts.append("\n\n".join([f"## {i}. {e['question']}", f"Years asked: {', '.join(map(str, e['years'])) or '-'}", ranks, *lists]))
    return "\n\n".join(parts) + "\n"


def comparison_markdown(rows: list[dict], years: dict, label: str, k: int = 5) -> str:
    """rows: retriever, mrr, top_1, recall_k; years: the counts of `diagnostics.year_evidence`."""
    names = {"semantic": label, "token": f"{label} behind the question's years", "interval": f"{label} behind the years between them", "temporal": "Temporal engine", "hybrid": "Fusion"}
    found = {r["retriever"]: r for r in rows}
    lines = [[names[r], number(found[r]["mrr"]), number(found[r]["top_1"], 3), number(found[r]["recall_k"], 3)] for r in names if r in found]

    def of(part: str, whole: str) -> str:
        return f"{years[part]} of {years[whole]} ({years[part] / years[whole] if years[whole] else 0:.1%})"

    facts = [
        f"Questions that name a year: {of('dated', 'n')}.", f"Of these, gold lacks the years themselves: {of('gold_lacks_token', 'dated')}; any year between them: {of('gold_lacks_interval', 'dated')}.",
        f"The fusion puts gold first and {label} doesn't: {years['wins']}; of these a filter by years between fails: {of('wins_filter_fails', 'wins')}, and gold has no such year: {of('wins_gold_lacks_interval', 'wins')}.",
    ]
    return f"# Five retrievers, {years['n']} queries\n\n" + table(["Retriever", "MRR", "Gold@1", f"Recall@{k}"], lines) + "\n\n" + "\n".join(f"- {f}" for f in facts) + "\n"


def reducible_markdown(rows: list[dict], name: str) -> str:
    """rows of `diagnostics.reducible`, that of all items first."""
    rows = sorted(rows, key=lambda r: (r["subset"] != "all", r["subset"]))
    lines = [[name if r["subset"] == "all" else f"{name}, {r['subset']}", str(r["n"]), f"{r['gold_share']:.1%}", *(number(r[c], 3) for c in ("mrr_timestamp", "mrr_temporal", "mrr_semantic"))] for r in rows]
    return "# How far years alone go\n\n" + table(["Benchmark", "Queries", "Gold with a year of the question", "Years alone", "Temporal", "Semantic"], lines) + "\n"


def answers_markdown(rows: list[dict], benchmark: str, generator: str, top_k: int, split: str) -> str:
    """rows: label, alpha, num_queries, num_scored and the means."""
    head = ["Method", "Alpha", "Queries", "Scored", f"Recall@{top_k}", "MRR", f"NDCG@{top_k}", "EM", "F1", "Containment"]
    lines = [[r["label"], number(r["alpha"], 1), str(r["num_queries"]), str(r["num_scored"]), *(number(r[c], 6) for c in ("recall", "mrr", "ndcg", "em", "f1", "containment"))] for r in rows]
    return f"# Generated answers\n\n- Benchmark: {benchmark}\n- Generator: {generator}\n- Top k: {top_k}\n- Split: {split}\n\n" + table(head, lines) + "\n"


def write_answers(spark: SparkSession, folder: str, predictions: DataFrame, rows: list[dict], config: dict, **head) -> None:
    """report.md, config.json, metrics/<run>.json, and predictions as JSON lines in a folder for each run_id."""
    put_text(spark, f"{folder}/report.md", answers_markdown(rows, **head))
    put_json(spark, f"{folder}/config.json", config)
    for r in rows:
        put_json(spark, f"{folder}/metrics/{slug(r['label'])}.json", r)
    predictions.withColumn("run", F.regexp_replace("run_id", r"[^A-Za-z0-9._+-]+", "_")).write.mode("overwrite").partitionBy("run").json(f"{folder}/predictions")


def alpha_domain(rows: list[dict]) -> list[float]:
    """The alphas that occur, ascending; tenths from 0.1 to 0.9 where none does."""
    return sorted({r["alpha"] for r in rows if r["alpha"] is not None}) or [i / 10 for i in range(1, 10)]


def benchmark_order(rows: list[dict]) -> list[str]:
    """The benchmarks that occur: those of the catalogue in its order, then others by name."""
    names = {r["benchmark"] for r in rows}
    return [b for b in BENCHMARKS if b in names] + sorted(names - set(BENCHMARKS))


def by_run(rows: list[dict]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in rows:
        out.setdefault(r["run_id"], []).append(r)
    return out
