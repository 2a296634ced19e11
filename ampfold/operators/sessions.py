"""Session-level features (15 built-ins + user extractors), timeline, run summary, schema union.

``session_features`` never puts a session into one task: every branch is either a partial
aggregation or an ordered pass over contiguous chunks (file splits, or range partitions):

(a) order-free aggregates per session: fits, means, max, arg-max, presence flags;
(b) distinct values and smallest mode of the discrete columns: two-level aggregation over
    ``(session, column, value)`` counts (no ``count(DISTINCT)`` Expand, no per-group maps);
(c) jump counts in file order: chunks = file splits, so no range shuffle is needed;
(d) trapezoid areas in capacity order: range chunks, both areas from one pass.

The four session-keyed results (small: one row per session each) are merged by
``unionByName`` + ``groupBy`` - one exchange instead of three joins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampfold.functions import signals as S
from ampfold.functions.paths import group_dir_of, path_datetime, report_datetime, root_prefix
from ampfold.operators import signals as ops
from ampfold.operators.mergeable import MergeableExtractor, merged_features
from ampfold.plans import ordered
from ampfold.plans.staging import stage as _stage
from ampfold.plans.staging import all_but, stage_readable
from ampfold.session import remove_scratch, scratch_path
from ampfold.sources import records, session_csv
from ampfold.sources.archives import damaged_archives
from ampfold.sources.listing import batches_of, by_driver
from ampfold.sources.session_csv import (CAPACITY, CURRENT, DQDV, DURATION, ORDER, SESSION_COLUMNS,
                                         TEMPERATURE, VOLTAGE)

KEY = "session_file"

# Names of the 15 built-in session features, in their output order.
F_V_SLOPE = f"{VOLTAGE}_vs_{CAPACITY}_slope"
F_V_R2 = f"{VOLTAGE}_vs_{CAPACITY}_r2"
F_V_MEAN = f"{VOLTAGE}_mean"
F_C_UNIQUE, F_C_MODE, F_C_JUMPS = f"{CURRENT}_unique", f"{CURRENT}_mode", f"{CURRENT}_jumps"
F_T_UNIQUE, F_T_MODE, F_T_JUMPS = f"{TEMPERATURE}_unique", f"{TEMPERATURE}_mode", f"{TEMPERATURE}_jumps"
F_D_SLOPE = f"{DURATION}_vs_{CAPACITY}_slope"
F_D_MEAN = f"{DURATION}_mean"
F_Q_MAX = f"{DQDV}_max"
F_Q_PEAK = f"{DQDV}_peak_capacity"
F_Q_AREA = f"{DQDV}_area_under_curve"
F_Q_POS = f"{DQDV}_positive_area"
FEATURES = [F_V_SLOPE, F_V_R2, F_V_MEAN, F_C_UNIQUE, F_C_MODE, F_C_JUMPS, F_T_UNIQUE, F_T_MODE, F_T_JUMPS,
            F_D_SLOPE, F_D_MEAN, F_Q_MAX, F_Q_PEAK, F_Q_AREA, F_Q_POS]
LONG_FEATURES = {F_C_UNIQUE, F_C_JUMPS, F_T_UNIQUE, F_T_JUMPS}
JUMP_THRESHOLD = 0.1


# ---------------------------------------------------------------------------------------
# User extractors (X-01)
# ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnExtractor:
    """Preferred kind: an aggregate Column (or a dict name -> Column) evaluated per session in Catalyst.

    It cannot catch errors per session: use ``try_*`` functions for anything that may fail.
    """

    name: str
    fn: Callable[[], Column | Mapping[str, Column]]


@dataclass(frozen=True)
class PandasExtractor:
    """Slow path: ``fn(pandas.DataFrame of one session, file order) -> scalar | dict``.

    Runs through ``groupBy(session).applyInPandas``: a whole session goes to one Python worker,
    so use it only for bounded sessions (a :class:`MergeableExtractor` spreads a session). An exception is recorded in ``extractor_errors`` and only
    that extractor's features are missing.
    """

    name: str
    fn: Callable
    columns: Sequence[str] = tuple(SESSION_COLUMNS)


_ENTRY = "struct<v: double, i: int>"  # a custom feature's value, and the number of the extractor that gave it


def _column_extractor_aggs(extractors) -> list[Column]:
    """One aggregate per feature name; of several extractors with the name, the last."""
    found = {}
    for i, ex in enumerate(extractors):
        if isinstance(ex, ColumnExtractor):
            res = ex.fn()
            for k, c in res.items() if isinstance(res, Mapping) else [(ex.name, res)]:
                found[k] = F.struct(c.cast("double").alias("v"), F.lit(i).alias("i"))
    return [F.struct(F.lit(k).alias("k"), v.alias("e")).alias(f"_cx_{n}") for n, (k, v) in enumerate(found.items())]


def _pandas_extractor_frame(rows: DataFrame, extractors) -> DataFrame | None:
    pex = [(i, ex) for i, ex in enumerate(extractors) if isinstance(ex, PandasExtractor)]
    if not pex:
        return None
    cols = sorted({c for _, ex in pex for c in ex.columns})
    schema = T.StructType([
        T.StructField(KEY, T.StringType()),
        T.StructField("_px", T.MapType(T.StringType(), T.StructType([T.StructField("v", T.DoubleType()), T.StructField("i", T.IntegerType())]))),
        T.StructField("extractor_errors", T.ArrayType(T.StringType())),
    ])

    def run(pdf):
        import math

        import pandas as pd

        pdf = pdf.sort_values(ORDER, kind="mergesort")
        session = pdf[KEY].iloc[0]
        data = pdf[cols].reset_index(drop=True)
        feats, errors = {}, []
        for i, ex in pex:
            try:
                res = ex.fn(data)
                for k, v in res.items() if isinstance(res, Mapping) else [(ex.name, res)]:
                    v = None if v is None else float(v)
                    feats[str(k)] = {"v": None if v is None or math.isnan(v) else v, "i": i}
            except Exception as e:  # noqa: BLE001 - isolate one extractor, as documented
                errors.append(f"{ex.name}: {type(e).__name__}: {e}")
        return pd.DataFrame({KEY: [session], "_px": [feats], "extractor_errors": [errors]})

    return rows.select(KEY, *ORDER, *cols).groupBy(KEY).applyInPandas(run, schema)


# ---------------------------------------------------------------------------------------
# Built-in features
# ---------------------------------------------------------------------------------------


def _any(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _has(c: str) -> Column:
    return F.max(F.col(f"_has_{c}").cast("int")) == 1


def _order_free(rows: DataFrame, extractors) -> DataFrame:
    V, C, Tm, D, Q, X = (F.col(c) for c in (VOLTAGE, CURRENT, TEMPERATURE, DURATION, DQDV, CAPACITY))
    if "vehicle" in rows.columns:
        keys = [F.max("vehicle").alias("vehicle"), F.max("session_ts").alias("session_ts")]
    else:  # per-file constants: derived once per session after the aggregate
        keys = [F.max("_root").alias("_root")]
    aggs = [
        *keys,
        F.count(F.lit(1)).alias("n_rows"),
        *[_has(c).alias(f"has_{c}") for c in SESSION_COLUMNS],
        F.max(_any([F.col(f"_bad_{c}") for c in SESSION_COLUMNS if c != CAPACITY]).cast("int")).alias("_bad"),
        F.max(F.col(f"_bad_{CAPACITY}").cast("int")).alias("_bad_x"),
        S.fit_slope(V, X).alias(F_V_SLOPE),
        S.fit_r2(V, X).alias(F_V_R2),
        F.avg(V).alias(F_V_MEAN),
        S.fit_slope(D, X).alias(F_D_SLOPE),
        F.avg(D).alias(F_D_MEAN),
        F.max(Q).alias(F_Q_MAX),
        S.value_at_first_max(X, Q, ORDER).alias(F_Q_PEAK),
        F.count(Q).alias("_q_count"),
        *_column_extractor_aggs(extractors),
    ]
    return rows.groupBy(KEY).agg(*aggs)


def _discrete(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n_unique (missing counts as a value) and smallest mode, via (session, column, value) counts."""
    pairs = rows.select(KEY, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v"))
                                                  for i, c in enumerate(cols)])).alias("p"))
    counts = pairs.groupBy(KEY, F.col("p.c").alias("c"), F.col("p.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(KEY, "c").agg(
        F.count(F.lit(1)).alias("u"),
        F.min_by(F.col("v"), F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("nn"), F.col("v")))).alias("m"),
    )
    out = per.groupBy(KEY).agg(
        *[F.max(F.when(F.col("c") == i, F.col("u"))).alias(f"_u{i}") for i in range(len(cols))],
        *[F.max(F.when(F.col("c") == i, F.col("m"))).alias(f"_m{i}") for i in range(len(cols))],
    )
    return out


def empty_session_features(headers: DataFrame) -> DataFrame:
    """Feature rows for header-only session files: present columns give the empty-data values
    (fit 0, unique 0, jumps 0, means and modes null); dQ/dV features are null and flagged."""
    h = headers.where((F.col("n_rows") <= 0) & F.col("columns").isNotNull())
    has = {c: F.array_contains("columns", c) for c in SESSION_COLUMNS}
    zero_d, zero_l, null_d = F.lit(0.0), F.lit(0).cast("long"), F.lit(None).cast("double")
    feats = {
        F_V_SLOPE: F.when(has[VOLTAGE], zero_d), F_V_R2: F.when(has[VOLTAGE], zero_d), F_V_MEAN: null_d,
        F_C_UNIQUE: F.when(has[CURRENT], zero_l), F_C_MODE: null_d, F_C_JUMPS: F.when(has[CURRENT], zero_l),
        F_T_UNIQUE: F.when(has[TEMPERATURE], zero_l), F_T_MODE: null_d, F_T_JUMPS: F.when(has[TEMPERATURE], zero_l),
        F_D_SLOPE: F.when(has[DURATION], zero_d), F_D_MEAN: null_d,
        F_Q_MAX: null_d, F_Q_PEAK: null_d, F_Q_AREA: null_d, F_Q_POS: null_d,
    }
    return h.select(
        group_dir_of(KEY, "_root").alias("vehicle"), KEY, path_datetime(KEY).alias("session_ts"),
        F.lit(0).cast("long").alias("n_rows"), F.lit(False).alias("non_numeric"),
        has[DQDV].alias("dqdv_all_missing"), *[has[c].alias(f"has_{c}") for c in SESSION_COLUMNS],
        *[(feats[f].cast("long") if f in LONG_FEATURES else feats[f].cast("double")).alias(f) for f in FEATURES],
        F.create_map().cast("map<string,double>").alias("custom"),
    ).where(F.col("vehicle") != F.lit(""))


def session_features(rows: DataFrame, extractors: Sequence = (), chunk: Column | None = None,
                     stage: bool = True, keep_root_files: bool = False,
                     headers: DataFrame | None = None) -> DataFrame:
    """One row per session file: keys, flags, the 15 built-in features, and ``custom`` (map) features.

    ``rows`` is the output of :func:`ampfold.sources.session_csv.read_sessions` (or any frame with
    the same columns). ``chunk`` defaults to the file split, which is contiguous in file order.
    ``stage`` lands the parsed rows once as Parquet (shared folder) so the four branches read
    pruned columns instead of parsing the CSV tree four times. ``headers``
    (:func:`ampfold.sources.session_csv.session_headers`) adds the sessions without data rows, which give no row
    here; :class:`SessionTree` passes it always.
    """
    chunk = F.col("_bs") if chunk is None else chunk
    if stage:
        rows = _stage(rows, "session-rows")
    a = _order_free(rows, extractors)
    b = _discrete(rows, [CURRENT, TEMPERATURE]).select(
        KEY, F.col("_u0").alias(F_C_UNIQUE), F.col("_m0").alias(F_C_MODE),
        F.col("_u1").alias(F_T_UNIQUE), F.col("_m1").alias(F_T_MODE))
    c = ops.jump_counts(rows, KEY, ORDER, {F_C_JUMPS: CURRENT, F_T_JUMPS: TEMPERATURE},
                        threshold=JUMP_THRESHOLD, chunk=chunk)
    d = ops.curve_areas(rows, KEY, x=CAPACITY, y=DQDV, tie=ORDER, area=F_Q_AREA, positive=F_Q_POS)

    parts = [a, b, c, d]
    px = _pandas_extractor_frame(rows, extractors)
    parts += [p for p in (px, _mergeable_frame(rows, extractors)) if p is not None]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    agg_cols = [x for x in merged.columns if x != KEY]

    def pick(col: str) -> Column:
        dt = merged.schema[col].dataType
        if isinstance(dt, (T.MapType, T.ArrayType, T.StructType)):
            return F.first(col, ignorenulls=True).alias(col)
        if isinstance(dt, T.BooleanType):
            return F.max(F.col(col).cast("int")).cast("boolean").alias(col)
        return F.max(col).alias(col)

    m = merged.groupBy(KEY).agg(*[pick(x) for x in agg_cols])

    has = {c: F.col(f"has_{c}") for c in SESSION_COLUMNS}
    q_ok = has[DQDV] & (F.col("_q_count") > 0)
    text_x = F.col("_bad_x") == 1  # text in the capacities: no fit; with a dQ/dV column the file is rejected
    fit = lambda name: F.when(text_x, F.lit(0.0)).otherwise(F.col(name))
    feats = {
        F_V_SLOPE: F.when(has[VOLTAGE], fit(F_V_SLOPE)),
        F_V_R2: F.when(has[VOLTAGE], fit(F_V_R2)),
        F_V_MEAN: F.when(has[VOLTAGE], F.col(F_V_MEAN)),
        F_C_UNIQUE: F.when(has[CURRENT], F.col(F_C_UNIQUE)),
        F_C_MODE: F.when(has[CURRENT], F.col(F_C_MODE)),
        F_C_JUMPS: F.when(has[CURRENT], F.coalesce(F.col(F_C_JUMPS), F.lit(0))),
        F_T_UNIQUE: F.when(has[TEMPERATURE], F.col(F_T_UNIQUE)),
        F_T_MODE: F.when(has[TEMPERATURE], F.col(F_T_MODE)),
        F_T_JUMPS: F.when(has[TEMPERATURE], F.coalesce(F.col(F_T_JUMPS), F.lit(0))),
        F_D_SLOPE: F.when(has[DURATION], fit(F_D_SLOPE)),
        F_D_MEAN: F.when(has[DURATION], F.col(F_D_MEAN)),
        F_Q_MAX: F.when(q_ok, F.col(F_Q_MAX)),
        F_Q_PEAK: F.when(q_ok & has[CAPACITY], F.col(F_Q_PEAK)),
        F_Q_AREA: F.when(q_ok & has[CAPACITY], F.coalesce(F.col(F_Q_AREA), F.lit(0.0))),
        F_Q_POS: F.when(q_ok & has[CAPACITY], F.coalesce(F.col(F_Q_POS), F.lit(0.0))),
    }
    custom = _custom_map(m, extractors)
    errors = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("extractor_errors", "_mx_errors") if c in m.columns]
    if "vehicle" not in m.columns:
        m = m.withColumn("vehicle", group_dir_of(KEY, "_root")).withColumn("session_ts", path_datetime(KEY))
        if not keep_root_files:
            m = m.where(F.col("vehicle") != F.lit(""))
    out = m.select(
        "vehicle", KEY, "session_ts", F.col("n_rows").cast("long").alias("n_rows"),
        ((F.col("_bad") == 1) | (text_x & has[DQDV])).alias("non_numeric"),
        (has[DQDV] & (F.col("_q_count") == 0)).alias("dqdv_all_missing"),
        *[has[c].alias(f"has_{c}") for c in SESSION_COLUMNS],
        *[(feats[f].cast("long") if f in LONG_FEATURES else feats[f].cast("double")).alias(f) for f in FEATURES],
        custom.alias("custom"),
        *([F.concat(*errors).alias("extractor_errors")] if errors else []),
    )
    if headers is not None:
        out = out.unionByName(empty_session_features(headers), allowMissingColumns=True)
    return out


def _mergeable_frame(rows: DataFrame, extractors) -> DataFrame | None:
    found = [(i, ex) for i, ex in enumerate(extractors) if isinstance(ex, MergeableExtractor)]
    if not found:
        return None
    out = merged_features(rows, KEY, ORDER, found)
    return out.select(F.col("key").alias(KEY), F.col("features").alias("_mx"), F.col("errors").alias("_mx_errors"))


def _custom_map(m: DataFrame, extractors) -> Column:
    """Custom features as one map. Of extractors that give the same name the last wins, of a custom and a
    built-in feature the built-in."""
    empty = F.create_map().cast(f"map<string, {_ENTRY}>")
    entries = [F.col(c) for c in m.columns if c.startswith("_cx_")]
    columns = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())) if entries else empty
    last = columns
    for frame in ("_px", "_mx"):
        if frame in m.columns:
            last = F.map_zip_with(last, F.coalesce(F.col(frame), empty), lambda k, a, b: F.when(a.isNull() | (b["i"] > a["i"]), b).otherwise(a))
    return F.map_filter(F.transform_values(last, lambda k, e: e["v"]), lambda k, v: ~k.isin(*FEATURES))


class SessionTree:
    """A folder of session files, read once: all Stage-1 operators share its staged rows.

    ``profile`` (one scan, which lands the lines of small files too) finds files without data rows, of any size, ragged files, files with cells that run over
    line ends, and each file's charset; ``rows`` is the one parse of all files, landed as Parquet. Files that are not
    plain lines of UTF-8 are read split by split too (:mod:`ampfold.sources.records`), each in its own charset, which an
    ``encoding`` for the whole tree overrides. A file that a scan cannot read to its end is taken by none and listed by
    :meth:`rejected`. :meth:`release` removes what was landed when no result that reads it is needed any more.
    ``lazy``: the files are read when their content is first asked for; :meth:`sessions` never does.
    """

    def __init__(self, spark: SparkSession, root: str, glob: str = "*.csv", encoding: str | None = None,
                 files: Sequence[str] | None = None, lazy: bool = False):
        self.spark, self.root, self.glob, self.files, self.encoding = spark, root, glob, files, encoding
        self.paths = [scratch_path(spark, f"session-{name}") for name in ("profile", "rows", "lines", "odd-profile", "odd-rows", "odd-records", "other-rows", "listing")]
        self._profile = self._rows = self._listing = None
        if not lazy:
            self.read()

    @property
    def profile(self) -> DataFrame:
        return self.read()._profile

    @property
    def rows(self) -> DataFrame:
        return self.read()._rows

    @property
    def listing(self) -> DataFrame:
        """The files, listed once (:func:`ampfold.sources.listing.file_tree`)."""
        if self._listing is None:
            self._listing = session_csv.file_tree(self.spark, self.root if self.files is None else list(self.files), self.glob, self.paths[7])
        return self._listing

    def read(self) -> SessionTree:
        """Reads the files, unless it has been done."""
        if self._rows is None:
            self._read()
        return self

    def _read(self) -> None:
        spark, root, glob, encoding, files = self.spark, self.root, self.glob, self.encoding, self.files
        source = root if files is None else list(files)
        listing = self.listing
        damaged = damaged_archives(spark, source, glob, listing=listing)
        whole, unread = stage_readable(
            lambda only: session_csv.file_profile(spark, root, glob, files, only, listing, with_lines=True), listing, "profile", self.paths[0], damaged)
        profile = whole.drop("plain", "lines")
        if files is None and profile.isEmpty():
            raise ValueError(f"no readable session file below {root}")
        foreign = F.col("charset") != "UTF-8" if encoding is None else F.lit(False)
        is_odd = F.col("multiline") | foreign
        odd = profile.where(is_odd).select(
            "file", "multiline", F.col("charset") if encoding is None else F.lit(encoding).alias("charset"))
        classes = records.classes_of(odd)
        left_out = [*damaged, *unread]
        plain = F.col("plain") if encoding in (None, "UTF-8") else F.lit(False)  # read whole, by a plain split
        rest = whole.where(~plain & ~is_odd).select("file")
        few = records.classes_of(rest) if not whole.where(plain).isEmpty() else None  # None: all files are left to the CSV source

        def scan(only: Column, some: list[str] | None = None) -> DataFrame:
            if some is not None:
                return session_csv.read_sessions(spark, root, glob=glob, encoding=encoding or "UTF-8", files=some, only=only, literal=True)
            near = only if few is None else only & records.file_class().isin(few)
            rows = session_csv.read_sessions(spark, root, glob=glob, encoding=encoding or "UTF-8", files=files, only=near)
            if few is None:
                return records.without_files(rows, odd, classes, KEY)
            return rows.join(rest.select(F.col("file").alias(KEY)), KEY, "left_semi")

        more: list[int] = []
        parts = [] if few is None else [_stage(session_csv.rows_of_lines(whole.where(plain), root), "rows", self.paths[1])]
        if not by_driver(listing):
            for i, some in enumerate(batches_of(rest)):
                others, unread = stage_readable(lambda only, some=some: scan(only, some), listing, "other-rows", f"{self.paths[6]}/{i}", left_out)
                more = [*more, *unread]
                parts.append(others)
        elif few != []:
            others, more = stage_readable(scan, listing, "other-rows", self.paths[6], left_out)
            parts.append(others)
        if classes:
            true, rows, unread = self._read_odd(source, listing, whole, odd, classes, [*left_out, *more])
            parts.append(rows)
            profile, more = self._corrected(profile, odd, true), [*more, *unread]
        rows = parts[0] if parts else _stage(session_csv.rows_of_lines(whole.limit(0), root), "rows", self.paths[1])
        for part in parts[1:]:
            rows = rows.unionByName(part)
        self._profile, self._rows = profile, rows
        if more:
            self._profile = profile.where(all_but(more, "file"))
            self._rows = rows.where(all_but(more, KEY))

    def _read_odd(self, source, listing: DataFrame, whole: DataFrame, odd: DataFrame, classes: list[int], left_out: list[int]) -> tuple[DataFrame, DataFrame, list[int]]:
        """The profile by their records, and the rows, of the files that are not plain lines of UTF-8; and the hashes of those that cannot be read."""
        names, more = odd.select("file"), []
        large = session_csv.has_large_files(listing)

        def scan(only: Column) -> DataFrame:
            only = only & ~session_csv.is_small(self.spark) & records.file_class().isin(classes)
            return session_csv.large_lines(self.spark, source, self.glob, only, True, listing).join(names, "file", "left_semi")

        lines = session_csv.exploded_lines(whole.select("file", "lines").join(names, "file", "left_semi"))
        if large:
            split, more = stage_readable(scan, listing, "lines", self.paths[2], left_out)
            lines = lines.unionByName(split)
        else:
            lines = _stage(lines, "lines", self.paths[2])
        made = _stage(session_csv.odd_records(lines, odd), "odd-records", self.paths[5])
        true = _stage(session_csv.odd_profile(made), "odd-profile", self.paths[3])
        rows = session_csv.odd_rows(made, true, self.root).repartition(KEY, "_bs").sortWithinPartitions(KEY, *ORDER)
        return true, _stage(rows, "odd-rows", self.paths[4]), more  # a split's rows in file order, as in the scan

    @staticmethod
    def _corrected(profile: DataFrame, odd: DataFrame, true: DataFrame) -> DataFrame:
        seen = true.select("file", *[F.col(c).alias(f"_{c}") for c in ("columns", "n_cols", "n_records", "max_cells")])
        both = profile.join(odd.select("file", F.lit(True).alias("_odd")), "file", "left").join(seen, "file", "left")

        def pick(name: str, own: str) -> Column:
            return F.when(F.col("_odd"), F.col(own)).otherwise(F.col(name)).alias(name)

        lacking = F.col("_n_records").cast("long") <= 0  # a file of a header alone, over several lines
        return both.select(
            "vehicle", "file", pick("columns", "_columns"), pick("n_cols", "_n_cols"),
            F.when(lacking, F.col("_n_records").cast("long")).otherwise(F.col("n_rows")).alias("n_rows"),
            pick("max_cells", "_max_cells"), "multiline", "charset")

    def features(self, extractors: Sequence = ()) -> DataFrame:
        """The features of every file that can be taken (see :meth:`rejected`), files without data rows included."""
        out = session_features(self.rows, extractors, stage=False, headers=session_csv.session_headers(self.profile, self.root))
        return out.join(session_csv.broken(self.profile).select(F.col("file").alias(KEY)), KEY, "left_anti")

    def rejected(self, features: DataFrame | None = None) -> DataFrame:
        """``path, reason, severity`` of every file that is left out or taken with nulls (``features``: those of
        :meth:`features`, where they are at hand)."""
        return rejected_sessions(self.features() if features is None else features).unionByName(
            session_csv.file_problems(self.spark, self.root if self.files is None else list(self.files), self.profile, self.glob, self.listing))

    def sessions(self) -> DataFrame:
        """``vehicle, session_file, session_ts`` of all files, from their paths alone (no content is read)."""
        listed = self.listing.select(F.col("_metadata.file_path").alias(KEY), F.lit(root_prefix(self.root)).alias("_root"))
        return listed.select(group_dir_of(KEY, "_root").alias("vehicle"), KEY, path_datetime(KEY).alias("session_ts"))

    def release(self) -> None:
        remove_scratch(self.spark, self.paths)


def valid_sessions(features: DataFrame) -> DataFrame:
    """Sessions the feature table keeps: files with a non-numeric cell in a used column are dropped."""
    return features.where(~F.col("non_numeric"))


def rejected_sessions(features: DataFrame) -> DataFrame:
    """``path, reason, severity`` for dropped sessions (error) and kept-with-nulls sessions (warn)."""
    err = features.where(F.col("non_numeric")).select(F.col(KEY).alias("path"), F.lit("non_numeric").alias("reason"),
                                                     F.lit("error").alias("severity"))
    warn = features.where(F.col("dqdv_all_missing")).select(F.col(KEY).alias("path"),
                                                           F.lit("dqdv_all_missing").alias("reason"),
                                                           F.lit("warn").alias("severity"))
    return err.unionByName(warn)


# ---------------------------------------------------------------------------------------
# Timeline, run summary, schema union
# ---------------------------------------------------------------------------------------


def session_timeline(features: DataFrame, group: str = "vehicle") -> DataFrame:
    """Sessions of each group in time order (ties by path) with their 0-based position; skew-safe."""
    return ordered.dense_positions(features, group, ["session_ts", KEY], name="position")


def run_summary(features: DataFrame, group: str = "vehicle") -> DataFrame:
    """Files per group, feature count, first / last session time; the ``rollup`` total row has group null."""
    non_null = [F.max(F.col(f).isNotNull().cast("int")) for f in FEATURES]
    out = features.rollup(group).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.countDistinct(group).alias("n_groups"),
        F.min("session_ts").alias("first_ts"),
        F.max("session_ts").alias("last_ts"),
        *[x.alias(f"_nn{i}") for i, x in enumerate(non_null)],
    )
    n_feat = sum((F.col(f"_nn{i}") for i in range(len(FEATURES))), F.lit(0))
    return out.select(
        group, F.col("n_files").cast("long").alias("n_files"), F.col("n_groups").cast("long").alias("n_groups"),
        n_feat.cast("long").alias("n_features"),
        report_datetime("first_ts").alias("first_time"), report_datetime("last_ts").alias("last_time"),
    )


def schema_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns missing from a frame are null; order = first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
