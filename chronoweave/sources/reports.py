"""Reports: Markdown tables, JSON lines of predictions, the alpha curve as SVG, configuration files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import results

# The columns of the report format.
COLUMNS = ("run_id", "run_type", "temporal_model", "semantic_model", "alpha", "benchmark", "num_queries", "mrr", "ndcg", "recall", "precision")


def markdown(rows: list[dict], columns: tuple[str, ...] = COLUMNS) -> str:
    """A table; numbers with six places, nothing as -."""
    def cell(v) -> str:
        return "-" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def report(rows: DataFrame, order: list[str], macro_average: bool = True) -> str:
    """A report of runs with a section of means over benchmarks, if asked. A row for each run and benchmark reaches the driver."""
    found = [r.asDict() for r in rows.collect()]
    found.sort(key=lambda r: (order.index(r["benchmark"]) if r["benchmark"] in order else len(order), r["run_id"]))
    if not macro_average:
        return "# Results\n\n" + markdown(found)
    means = rows.groupBy("run_id").agg(*[F.avg(c).alias(c) for c in ("mrr", "ndcg", "recall", "precision")]).orderBy("run_id").collect()
    return "# Results\n\n" + markdown(found) + "\n## Means over benchmarks\n\n" + markdown([r.asDict() for r in means], ("run_id", "mrr", "ndcg", "recall", "precision"))


def parse_rows(lines: DataFrame) -> DataFrame:
    """Rows of a report from its lines (value): those with eleven cells that aren't a head."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select(cells.alias("c")).where((F.size("c") == len(COLUMNS)) & ~F.lower(F.get("c", F.lit(0))).isin("run_id", "run id") & ~F.get("c", F.lit(0)).startswith("--"))
    kinds = {"alpha": "double", "num_queries": "int", "mrr": "double", "ndcg": "double", "recall": "double", "precision": "double"}
    return rows.select([F.nullif(F.get("c", F.lit(i)), F.lit("-")).try_cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(COLUMNS)])


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return parse_rows(spark.read.text(path))


def filter_rows(rows: DataFrame, benchmarks: list[str] | None = None, run_types: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """Rows of the named kinds; a row without a model passes."""
    for column, wanted in (("benchmark", benchmarks), ("run_type", run_types)):
        if wanted:
            rows = rows.where(F.col(column).isin(wanted))
    return rows.where(F.col("semantic_model").isNull() | F.col("semantic_model").isin(models)) if models else rows


def axis(values: list[float]) -> tuple[float, float]:
    """Limits of a curve's axis: the range and a margin, within 0 and 1."""
    low, high = min(values), max(values)
    margin = max(0.08 * (high - low), 0.02) if high > low else 0.05
    return max(0.0, low - margin), min(1.0, high + margin)


def alpha_svg(rows: list[dict], width: int = 640, height: int = 400) -> str:
    """MRR over alpha, a line for each run; runs without alpha are level lines."""
    low, high = axis([r["mrr"] for r in rows])

    def at(alpha: float, mrr: float) -> tuple[float, float]:
        return 50 + alpha * (width - 70), height - 40 - (mrr - low) / ((high - low) or 1) * (height - 70)

    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    for i in range(5):
        v = low + (high - low) * i / 4
        parts.append(f'<text x="4" y="{at(0, v)[1]:.1f}" font-size="11">{v:.3f}</text>')
    for run in sorted({r["run_type"] for r in rows}):
        own = sorted((r for r in rows if r["run_type"] == run), key=lambda r: r["alpha"] or 0)
        points = [at(r["alpha"], r["mrr"]) for r in own if r["alpha"] is not None] or [at(0, own[0]["mrr"]), at(1, own[0]["mrr"])]
        parts.append(f'<polyline fill="none" stroke="black" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in points)}"><title>{run}</title></polyline>')
    return "\n".join([*parts, "</svg>"])


# The sections of a configuration file, and how a tagger's expressions may be combined.
SECTIONS = ("global", "benchmarks", "temporal", "semantic_baselines", "hybrid", "report")
TAGGER_SECTION = "sutime_hybrid"
TAGGER_MODES = ("merge", "union", "max", "mean", "product")


@dataclass
class Fusion:
    """Fusions of one engine, "temporal" or "tagger", with semantic models at alphas."""

    model: str
    semantic_models: list[str]
    alphas: list[float]
    engine: str = "temporal"


@dataclass
class Config:
    """An evaluation: benchmarks with paths, engines that run alone, fusions (by default of all of them at all alphas), k."""

    benchmarks: dict[str, str]
    temporal_models: list[str] = field(default_factory=list)
    semantic_models: list[str] = field(default_factory=list)
    alphas: list[float] = field(default_factory=lambda: [round(i / 10, 1) for i in range(1, 10)])
    top_k: int = 5
    fusions: list[Fusion] | None = None
    macro_average: bool = True

    def __post_init__(self):
        if not self.benchmarks:
            raise ValueError("no benchmark is enabled")
        if self.fusions is None:
            self.fusions = [Fusion(t, self.semantic_models, self.alphas) for t in self.temporal_models]
        self.fusions = [f if isinstance(f, Fusion) else Fusion(**f) for f in self.fusions]
        if bad := [a for a in [*self.alphas, *(a for f in self.fusions for a in f.alphas)] if not 0 <= a <= 1]:
            raise ValueError(f"alphas must lie between 0 and 1: {bad}")
        if bad := [f.model for f in self.fusions if f.engine == "tagger" and f.model not in TAGGER_MODES]:
            raise ValueError(f"a tagger's mode must be one of {', '.join(TAGGER_MODES)}: {bad}")
        if bad := [f.engine for f in self.fusions if f.engine not in ("temporal", "tagger")]:
            raise ValueError(f"no engine to fuse: {bad}")
        if self.top_k < 1:
            raise ValueError("top_k must be 1 or more")

    @staticmethod
    def parse(text: str, root: str = "data") -> Config:
        """Of a file's text: either this class's fields, or sections, whose benchmarks lie under `root` by their names in the catalogue."""
        raw = json.loads(text)
        if "retrieval" in raw:
            return Config._of_retrieval(raw, root)
        if "global" in raw:
            return Config._of_sections(raw, root)
        unknown = set(raw) - set(Config.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return Config(**raw)

    @staticmethod
    def _of_sections(raw: dict, root: str) -> Config:
        lacking = [name for name in SECTIONS if name not in raw]
        if lacking:
            raise ValueError(f"sections are missing: {lacking}")
        names = [name for name, entry in raw["benchmarks"].items() if entry.get("enabled")]
        if unknown := [name for name in names if name not in results.BENCHMARKS]:
            raise ValueError(f"unknown benchmarks: {unknown}; there are {', '.join(results.BENCHMARKS)}")

        def chosen(section: str, key: str) -> list:
            entry = raw.get(section, {})
            if not entry.get("enabled"):
                return []
            if not entry.get(key):
                raise ValueError(f"{section}.{key} is empty")
            return entry[key]

        fusions = []
        for section, engine, key in (("hybrid", "temporal", "temporal_model_name"), (TAGGER_SECTION, "tagger", "similarity_mode")):
            models = chosen(section, "semantic_models")
            if models:
                given = raw[section].get(key) or ("merge" if engine == "tagger" else raw["temporal"].get("model_name"))
                fusions.append(Fusion(given, models, raw[section].get("alphas", [0.5]), engine))
                if not fusions[-1].model or not fusions[-1].alphas:
                    raise ValueError(f"{section} has no {key} or no alphas")
        alone = [chosen("temporal", "model_name")] if raw["temporal"].get("enabled") else []
        out = Config({n: results.benchmark_path(root, n) for n in names}, alone, chosen("semantic_baselines", "models"), [], int(raw["global"].get("top_k", 5)), fusions, raw["report"].get("include_macro_average", True))
        if not out.runs():
            raise ValueError("no run is enabled")
        return out

    @staticmethod
    def _of_retrieval(raw: dict, root: str) -> Config:
        """Of a configuration of generated answers: each baseline alone and fused at its own alpha, on the one benchmark with raw answers."""
        given, name = raw["retrieval"], results.BENCHMARKS[0]
        model, baselines = given.get("temporal_model_name", "temporal"), given.get("baselines", [])
        fusions = [Fusion(model, [b["model"]], [float(b["alpha"])]) for b in baselines]
        alone = [model] if given.get("include_temporal_only") else []
        return Config({name: results.benchmark_path(root, name)}, alone, [b["model"] for b in baselines], [], int(raw.get("global", {}).get("top_k", 5)), fusions)

    def engines(self) -> list[tuple[str, str]]:
        """Kind and model of every engine whose scores the runs need, once each."""
        need = [("temporal", m) for m in self.temporal_models] + [("semantic", m) for m in self.semantic_models]
        return list(dict.fromkeys(need + [p for f in self.fusions for p in ((f.engine, f.model), *(("semantic", s) for s in f.semantic_models))]))

    def runs(self) -> list[tuple[str, str, str | None, str | None, float | None]]:
        """run_id, run_type, models and alpha of every run: each engine alone, and each fusion at each alpha."""
        out = [(f"temporal:{t}", "temporal", t, None, None) for t in self.temporal_models]
        out += [(f"semantic:{s}", "semantic", None, s, None) for s in self.semantic_models]
        kinds = {"temporal": "hybrid", "tagger": "tagger_hybrid"}
        return out + [(f"{kinds[f.engine]}:{f.model}+{s}@{a:g}", kinds[f.engine], f.model, s, float(a)) for f in self.fusions for s in f.semantic_models for a in f.alphas]


def write_predictions(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)
