"""Sources and reshaping of run and candidate tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Named benchmark presets (feature column(s), label column) of the
# molecule and reaction loaders.
BENCHMARK_PRESETS: dict[str, dict] = {
    "Photoswitch": {"features": "SMILES", "labels": "E isomer pi-pi* wavelength in nm"},
    "ESOL": {"features": "smiles", "labels": "measured log solubility in mols per litre"},
    "FreeSolv": {"features": "smiles", "labels": "expt"},
    "Lipophilicity": {"features": "smiles", "labels": "exp"},
    "DreherDoyle": {"features": ["ligand", "additive", "base", "aryl halide"], "labels": "yield"},
    "DreherDoyleRXN": {"features": "rxn", "labels": "yield"},
    "SuzukiMiyaura": {"features": ["reactant_1_smiles", "reactant_2_smiles", "catalyst_smiles",
                                   "ligand_smiles", "reagent_1_smiles", "solvent_1_smiles"],
                      "labels": "yield"},
    "SuzukiMiyauraRXN": {"features": "rxn", "labels": "yield"},
}

# Configuration renames and kernel class-path recoding of the results tables.
CONFIG_RENAMES = {
    "data.featurizer.init_args.representation": "representation",
    "surrogate_model.init_args.covar_module.init_args.base_kernel.class_path": "kernel",
    "data_selection.method": "init",
    "surrogate_model.init_args.normalize": "normalize",
    "data.featurizer.init_args.bond_radius": "bond_radius",
    "data.featurizer.init_args.nBits": "n_bits",
    "model.acquisition_class": "acquisition",
}
# Public kernel class paths and their short names (any other path is kept as it is).
KERNEL_SHORT = {
    "gpytorch.kernels.linear_kernel.LinearKernel": "Linear",
    "gpytorch.kernels.matern_kernel.MaternKernel": "Matern",
    "gpytorch.kernels.rq_kernel.RQKernel": "RQ",
}
INIT_RECODE = {"true_random": "random"}


def q(name: str) -> Column:
    """Column by a name that may contain dots or slashes."""
    return F.col(f"`{name}`")


# ------------------------------------------------------------------ A2
def load_labelled(df: DataFrame, feature_cols: str | Sequence[str], label_col: str) -> DataFrame:
    """A2: project feature and label columns, drop rows whose label is null (or NaN)."""
    feats = [feature_cols] if isinstance(feature_cols, str) else list(feature_cols)
    lab = q(label_col)
    keep = lab.isNotNull()
    if isinstance(df.schema[label_col].dataType, (T.DoubleType, T.FloatType)):
        keep = keep & ~F.isnan(lab)
    return df.select(*[q(c) for c in feats], lab).filter(keep)


def load_benchmark(df: DataFrame, name: str) -> DataFrame:
    if name not in BENCHMARK_PRESETS:
        raise ValueError(f"unknown benchmark '{name}'; choose one of {sorted(BENCHMARK_PRESETS)}")
    p = BENCHMARK_PRESETS[name]
    return load_labelled(df, p["features"], p["labels"])


# ------------------------------------------------------------------ A3
def ingest_run_logs(logs: DataFrame, json_col: str, json_schema: T.StructType | str,
                    out_col: str = "payload") -> DataFrame:
    """A3: parse the JSON payload of every log row with a declared schema (no inference pass).

    For a directory of JSON-lines logs use ``spark.read.schema(s).json(path)``;
    both paths give the same typed rows and parse in parallel per file split.
    """
    return logs.withColumn(out_col, F.from_json(F.col(json_col), json_schema)).drop(json_col)


def ingest_run_folder(spark: SparkSession, path: str, run_schema: T.StructType | str,
                      history_schema: T.StructType | str, runs: str = "*/summary.json",
                      history: str = "*/history.jsonl", with_rejects: bool = False) -> tuple[DataFrame, ...]:
    """A3: a folder of run logs -> (runs, history), every row with the ``run_dir`` it came from,
    and ``with_rejects`` a third table.

    One scan of JSON lines per kind of file with a declared schema: no inference pass, files
    split over tasks. A line that the schema can't read is a row of the rejects (run_dir, kind,
    line); blank lines are no rows.
    """
    def scan(pattern: str, schema: T.StructType | str) -> DataFrame:
        given = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
        parsed = F.from_json("value", f"{given}, _line string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"})
        lines = spark.read.text(f"{path.rstrip('/')}/{pattern}").filter(F.trim("value") != "")
        return lines.select(parsed.alias("p"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_dir"))

    def good(df: DataFrame) -> DataFrame:
        rows = df.filter("p._line is null")
        return rows.select(*[F.col(f"p.`{c}`") for c in rows.schema["p"].dataType.names if c != "_line"], "run_dir")

    both = {"run": scan(runs, run_schema), "history": scan(history, history_schema)}
    bad = [df.filter("p._line is not null").select("run_dir", F.lit(kind).alias("kind"), F.col("p._line").alias("line"))
           for kind, df in both.items()]
    tables = good(both["run"]), good(both["history"])
    return (*tables, bad[0].unionByName(bad[1])) if with_rejects else tables


# ------------------------------------------------------------------ A4 / A5
def flatten_config(df: DataFrame, sep: str = ".") -> DataFrame:
    """A4: nested struct columns -> flat columns named by the joined path (``a.b.c``)."""

    def walk(prefix: str, dtype: T.DataType, col: Column) -> list[Column]:
        if isinstance(dtype, T.StructType):
            if not dtype.fields:  # empty dicts vanish
                return []
            out = []
            for f in dtype.fields:
                out += walk(f"{prefix}{sep}{f.name}" if prefix else f.name, f.dataType, col[f.name])
            return out
        return [col.alias(prefix)]

    cols: list[Column] = []
    for f in df.schema.fields:
        cols += walk(f.name, f.dataType, q(f.name))
    return df.select(*cols)


def nest_config(df: DataFrame, sep: str = ".", bool_text: bool = True) -> DataFrame:
    """A5: dotted column names -> nested structs. Text columns holding only ``True``/``False``
    (ignoring nulls) become booleans; any other text stays text.

    A Spark column has one type, so the boolean decision is per column: one
    aggregate pass counts the non-boolean texts of every string column.
    """
    d = df
    if bool_text:
        strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if strings:
            row = df.agg(*[F.count(F.when(~q(c).isin("True", "False"), 1)).alias(str(i))
                           for i, c in enumerate(strings)]).first()
            conv = {c: (q(c) == F.lit("True")) for i, c in enumerate(strings) if row[str(i)] == 0}
            d = df.withColumns(conv) if conv else df
    tree: dict = {}
    for name in d.columns:
        node = tree
        parts = name.split(sep)
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        node[parts[-1]] = name

    def build(node: dict) -> list[Column]:
        out = []
        for k, v in node.items():
            out.append((F.struct(*build(v)) if isinstance(v, dict) else q(v)).alias(k))
        return out

    return d.select(*build(tree))


# ------------------------------------------------------------------ A6 .. A9
def zip_columns(summary: DataFrame, config: DataFrame, on: str = "run_id",
                names: DataFrame | None = None) -> DataFrame:
    """Glue summary, config (and names) side by side by key, never by position."""
    out = summary.join(config, on, "inner")
    return out.join(names, on, "inner") if names is not None else out


def drop_prefixed(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Drop every column whose name starts with one of the prefixes."""
    return df.drop(*[c for c in df.columns if any(c.startswith(p) for p in prefixes)])


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns without a single value; one aggregate pass counts them all."""
    row = df.agg(*[F.count(q(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    empty = [c for i, c in enumerate(df.columns) if row[str(i)] == 0]
    return df.drop(*empty) if empty else df


def sort_columns(df: DataFrame) -> DataFrame:
    """Columns in alphabetical order."""
    return df.select(*[q(c) for c in sorted(df.columns)])


# ------------------------------------------------------------------ A10
def shared_table_path(spark, name: str) -> str:
    """A folder under the cluster's shared checkpoint folder (``spark.checkpoint.dir``)."""
    from platewise.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def write_and_read_back(df: DataFrame, name: str, fmt: str = "parquet",
                        partition_by: Sequence[str] | None = None) -> DataFrame:
    """A10: write a table to the shared folder and return the re-read table (lineage cut)."""
    from platewise.sources.tables import write_table

    spark = df.sparkSession
    path = shared_table_path(spark, name)
    write_table(df, path, fmt=fmt, partition_by=list(partition_by) if partition_by else None)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").schema(df.schema)
    return reader.load(path)


# ------------------------------------------------------------------ A11
def standardise_names(df: DataFrame, renames: Mapping[str, str] = CONFIG_RENAMES,
                      kernels: Mapping[str, str] = KERNEL_SHORT,
                      inits: Mapping[str, str] = INIT_RECODE) -> DataFrame:
    """Rename config columns, recode whole kernel class paths and init names (unmatched kept).

    ``kernels`` adds or replaces paths, such as a project's own kernel classes.
    """
    present = {k: v for k, v in renames.items() if k in df.columns}
    d = df.withColumnsRenamed(present)

    def recode(col: str, mapping: Mapping[str, str]) -> Column:
        expr = q(col)
        for k, v in mapping.items():
            expr = F.when(q(col) == k, F.lit(v)).otherwise(expr)
        return expr

    upd = {}
    if "kernel" in d.columns:
        upd["kernel"] = recode("kernel", kernels)
    if "init" in d.columns:
        upd["init"] = recode("init", inits)
    return d.withColumns(upd) if upd else d


# ------------------------------------------------------------------ A12
def scale_by_reference(df: DataFrame, cols: Sequence[str], ref_col: str, order_col: str) -> DataFrame:
    """Cast text metrics to double and divide by the reference value of the first row.

    The first row's reference is one scalar (``min_by`` aggregate, partial), attached
    as a literal.
    """
    ref = df.agg(F.min_by(q(ref_col), q(order_col))).first()[0]
    return df.withColumns({c: q(c).cast("double") / F.lit(ref).cast("double") for c in cols})


# ------------------------------------------------------------------ A13 / A14
def melt_metrics(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                 var_name: str = "metric_type", value_name: str = "metric_value") -> DataFrame:
    """Wide metric columns -> (metric_type, metric_value) rows."""
    return df.unpivot(list(ids), list(values), var_name, value_name)


def concat_tables(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack tables whose columns differ (missing ones become null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# ------------------------------------------------------------------ A15
def update_results(df: DataFrame, results: DataFrame, id_col: str, target: str,
                   new_col: str = "value") -> DataFrame:
    """Write measured results into the target column, keyed on id (not row position).

    A target column that does not exist yet starts as 0.0. Rows without a result keep
    their old value (nulls included).
    """
    r = results.select(F.col(id_col).alias("__rid"), F.col(new_col).cast("double").alias("__new"))
    old = q(target) if target in df.columns else F.lit(0.0)
    out = df.join(r, F.col(id_col) == F.col("__rid"), "left")
    return out.withColumn(target, F.when(F.col("__rid").isNotNull(), F.col("__new")).otherwise(old)) \
        .drop("__rid", "__new")
