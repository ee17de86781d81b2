"""Named queries over the lexicons of fixtures.py and over pages and documents, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import analysis, compare, curate, dynamics, index, score
from ..sources import lexicon as source
from . import fixtures as fx
from . import reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Target lengths of definitions and their shares in percent.
LENGTH_SHARES = [(1, 6.0), (2, 15.0), (3, 20.0), (4, 18.0), (5, 13.0), (6, 9.0), (7, 6.0), (8, 4.0), (9, 3.0), (10, 2.0), (12, 2.0), (15, 1.0), (20, 0.7), (25, 0.2), (30, 0.1)]
DEEPEST = 14


def query(sql: str | None = None, recursive: bool = False, closed: bool = True, raw: bool = False, ctes: str = ""):
    """Registers a query; sql may use the closed (or raw) lexicons' CTEs and further ones."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            before = fx.raw_sql() if raw else fx.closed_sql() if closed else ""
            parts = ",\n".join(p for p in (before, ctes) if p)
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n" if parts else "") + sql
        return f

    return add


def _definition(df: DataFrame) -> DataFrame:
    return df.select("corpus", F.col("idx").cast("long").alias("idx"), "head", F.concat_ws(" ", "definition").alias("definition"))


_DEFINED = "CAST({idx} AS BIGINT) AS idx, head, string_agg(tok, ' ' ORDER BY pos) AS definition"

# Curation ---------------------------------------------------------------------------------------------------------------------


@query(f"SELECT corpus, {_DEFINED.format(idx='idx')} FROM base GROUP BY corpus, idx, head", raw=True)
def lexicon_load(spark, sf):
    lines = source.lexicon_lines(fx.base_lexicons(spark, sf)).select("corpus", F.col("idx").alias("line_no"), "line")
    return _definition(source.parse_lexicon(lines))


@query("SELECT corpus, CAST(idx AS BIGINT) AS idx, head FROM vocab")
def word_index(spark, sf):
    return fx.lexicons(spark, sf).select("corpus", F.col("idx").cast("long").alias("idx"), "head")


@query(f"SELECT corpus, {_DEFINED.format(idx='idx')} FROM lex GROUP BY corpus, idx, head")
def self_contained(spark, sf):
    return _definition(fx.lexicons(spark, sf))


def _close(first: str, name: str, rounds: int = 10) -> str:
    return ", ".join([f"{name}0 AS MATERIALIZED ({first})", *(f"{name}{k} AS MATERIALIZED (SELECT * FROM {name}{k - 1} x WHERE EXISTS (SELECT 1 FROM {name}{k - 1} y WHERE y.corpus = x.corpus AND y.head = x.tok))" for k in range(1, rounds + 1))])


def _md5(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8)) AS BIGINT)"


#: The raw lexicons less the entries of a third of the words, which stay as tokens, so that there is something to clean.
_OPENED = _close(f"SELECT * FROM t0 WHERE {_md5(chr(39) + '42' + chr(39), chr(39) + 'open' + chr(39), 'head')} * 3 >= 4294967296", "d", 25)


def _opened(spark, sf):
    return fx.raw(spark, sf).where(curate.chance(F.lit("42"), F.lit("open"), "head") * 3 >= 2**32)


@query("SELECT corpus, tok, count(*) AS n FROM (SELECT * FROM d0 EXCEPT ALL SELECT * FROM d25) GROUP BY corpus, tok", raw=True, ctes=_OPENED)
def dangling_counts(spark, sf):
    return curate.dangling_counts(_opened(spark, sf))


@query("SELECT DISTINCT corpus, head FROM d0 EXCEPT SELECT corpus, head FROM d25", raw=True, ctes=_OPENED)
def removed_headwords(spark, sf):
    return curate.removed_headwords(_opened(spark, sf))


_COMMON = "common AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY head) - 1 AS INTEGER) AS master_idx, head AS word FROM vocab GROUP BY head HAVING count(DISTINCT corpus) = 6)"


@query("SELECT * FROM common", ctes=_COMMON)
def common_vocabulary(spark, sf):
    return _common(spark, sf)


def _common(spark, sf):
    return fx._once("common", spark, sf, lambda: score.common_vocabulary(fx.lexicons(spark, sf), len(fx.CORPORA)))


@query("SELECT DISTINCT corpus, word FROM (SELECT corpus, head AS word FROM t0 UNION ALL SELECT corpus, tok FROM t0) WHERE regexp_full_match(word, '\\p{L}{2,}')", raw=True)
def valid_vocabulary(spark, sf):
    return curate.valid_vocabulary(fx.raw(spark, sf))


@query("SELECT corpus, tok, count(*) AS n FROM lex GROUP BY corpus, tok")
def token_frequency(spark, sf):
    return curate.token_frequency(fx.lexicons(spark, sf)).select("corpus", "tok", "n")


_RANKED = "ranked AS (SELECT corpus, tok, n, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, first) AS rank FROM (SELECT corpus, tok, count(*) AS n, min(idx * 1000 + pos) AS first FROM lex GROUP BY corpus, tok))"


@query("SELECT corpus, CAST(rank AS INTEGER) AS rank, tok, n FROM ranked WHERE rank <= 20", ctes=_RANKED)
def top_tokens(spark, sf):
    return curate.top_tokens(fx.lexicons(spark, sf))


@query("SELECT corpus, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS avg_length FROM (SELECT corpus, head, count(*) AS n FROM lex GROUP BY corpus, head) GROUP BY corpus")
def corpus_stats(spark, sf):
    return curate.corpus_stats(fx.lexicons(spark, sf))


_CUT = "cut AS (SELECT * FROM lex l WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.corpus = l.corpus AND r.rank <= {most} AND (r.tok = l.tok OR r.tok = l.head)))"


@query(f"SELECT corpus, {_DEFINED.format(idx='idx')} FROM cut GROUP BY corpus, idx, head", ctes=f"{_RANKED}, {_CUT.format(most=3)}")
def targeted_removal(spark, sf):
    return _definition(curate.targeted_removal(fx.lexicons(spark, sf), 3))


_SHARE = "greatest(1, (SELECT count(*) * 10 // 100 FROM vocab v WHERE v.corpus = l.corpus))"


@query(f"SELECT corpus, {_DEFINED.format(idx='idx')} FROM p10 GROUP BY corpus, idx, head", ctes=f"{_RANKED}, {_CUT.format(most=_SHARE)}, {_close('SELECT * FROM cut', 'p')}")
def targeted_pct_removal(spark, sf):
    return _definition(curate.targeted_pct_removal(fx.lexicons(spark, sf), 10))


@query(
    f"SELECT corpus, {_DEFINED.format(idx='idx')} FROM lex JOIN (SELECT corpus, head, count(*) AS n FROM lex GROUP BY ALL) USING (corpus, head) WHERE NOT (n > 1 AND {_md5(chr(39) + '42' + chr(39), chr(39) + 'hit' + chr(39), 'head')} * 100 < 20 * 4294967296 AND pos = {_md5(chr(39) + '42' + chr(39), chr(39) + 'at' + chr(39), 'head')} % n) GROUP BY corpus, idx, head"
)
def random_removal(spark, sf):
    return _definition(curate.random_removal(fx.lexicons(spark, sf)))


@query(
    f"SELECT corpus, {_DEFINED.format(idx='idx')} FROM q10 GROUP BY corpus, idx, head",
    ctes=f"hr AS (SELECT corpus, head, row_number() OVER (PARTITION BY corpus ORDER BY {_md5(chr(39) + '42' + chr(39), chr(39) + 'head' + chr(39), 'head')}, head) AS rank, count(*) OVER (PARTITION BY corpus) AS n FROM vocab), "
    + _close("SELECT * FROM lex l WHERE NOT EXISTS (SELECT 1 FROM hr WHERE hr.corpus = l.corpus AND hr.rank <= hr.n * 10 // 100 AND (hr.head = l.tok OR hr.head = l.head))", "q"),
)
def random_head_removal(spark, sf):
    return _definition(curate.random_head_removal(fx.lexicons(spark, sf), 10))


@query(
    f"SELECT l.corpus, CAST(l.idx AS BIGINT) AS idx, l.head, string_agg(v.head, ' ' ORDER BY pos) AS definition FROM lex l JOIN (SELECT corpus, count(*) AS n FROM vocab GROUP BY corpus) USING (corpus) JOIN vocab v ON v.corpus = l.corpus AND v.idx - 1 = {_md5(chr(39) + '42' + chr(39), chr(39) + 'null' + chr(39), 'l.head', 'pos')} % n GROUP BY l.corpus, l.idx, l.head"
)
def null_model(spark, sf):
    return _definition(curate.null_model(fx.lexicons(spark, sf)))


# Scores -------------------------------------------------------------------------------------------------------------------------

_WALKS = f"""wk AS (SELECT corpus, head AS seed, 0 AS lvl, head AS w, CAST(1 AS HUGEINT) AS cnt FROM vocab UNION ALL
  SELECT wk.corpus, seed, lvl + 1, ed.tok, CAST(sum(cnt * mult) AS HUGEINT) FROM wk JOIN ed ON ed.corpus = wk.corpus AND ed.head = wk.w WHERE lvl < {DEEPEST} GROUP BY wk.corpus, seed, lvl, ed.tok),
dist AS MATERIALIZED (SELECT corpus, seed, w, min(lvl) AS d FROM wk GROUP BY ALL)"""
_PAIRS = f"""{_WALKS},
p AS MATERIALIZED (SELECT a.corpus, a.idx AS idx1, b.idx AS idx2, a.head AS a, b.head AS b FROM vocab a JOIN vocab b ON a.corpus = b.corpus AND a.idx < b.idx),
og AS MATERIALIZED (SELECT corpus, idx1, idx2, least(max(d) + 1, 100) AS god FROM (SELECT corpus, idx1, idx2, w, min(d) AS d FROM (SELECT p.corpus, idx1, idx2, w, d FROM p JOIN dist x ON x.corpus = p.corpus AND x.seed = p.a UNION ALL SELECT p.corpus, idx1, idx2, w, d FROM p JOIN dist x ON x.corpus = p.corpus AND x.seed = p.b) GROUP BY ALL) GROUP BY ALL),
sides AS (SELECT corpus, idx1, idx2, 1 AS side, a AS self, b AS other FROM p UNION ALL SELECT corpus, idx1, idx2, 2, b, a FROM p),
x AS MATERIALIZED (SELECT s.corpus, idx1, idx2, side, lvl, coalesce(o.d, 1000000) AS od, sum(cnt) AS cnt FROM sides s JOIN wk ON wk.corpus = s.corpus AND wk.seed = s.self LEFT JOIN dist o ON o.corpus = s.corpus AND o.seed = s.other AND o.w = wk.w GROUP BY ALL),
tl AS (SELECT corpus, idx1, idx2, min(t) AS tl FROM (SELECT corpus, idx1, idx2, side, lvl, greatest(lvl, 1, max(od)) AS t FROM x GROUP BY corpus, idx1, idx2, side, lvl) GROUP BY ALL),
prs AS MATERIALIZED (SELECT corpus, CAST(idx1 AS INTEGER) AS idx1, CAST(idx2 AS INTEGER) AS idx2, CAST(CASE WHEN tl <= god + 1 THEN sc ELSE -1 END AS BIGINT) AS sod, CAST(CASE WHEN tl <= god + 1 THEN tl ELSE god + 1 END AS INTEGER) AS tl, CAST(god AS INTEGER) AS god
  FROM (SELECT corpus, idx1, idx2, tl, sum(CASE WHEN lvl <= tl AND od > tl THEN cnt * lvl ELSE 0 END) AS sc FROM x JOIN tl USING (corpus, idx1, idx2) GROUP BY ALL) JOIN og USING (corpus, idx1, idx2)),
sym AS MATERIALIZED (SELECT corpus, idx1 AS w, idx2 AS partner, sod, tl FROM prs WHERE sod <> -1 UNION ALL SELECT corpus, idx2, idx1, sod, tl FROM prs WHERE sod <> -1)"""


def _pairs(spark, sf):
    return fx._once("pairs", spark, sf, lambda: score.sod_pairs(fx.lexicons(spark, sf)))


def _sym(spark, sf):
    return fx._once("sym", spark, sf, lambda: index.pair_index(_pairs(spark, sf)))


@query("SELECT corpus, CAST(idx AS BIGINT) AS idx, CAST(least(max(d) + 1, 100) AS INTEGER) AS god FROM dist JOIN vocab v USING (corpus) WHERE v.head = seed GROUP BY corpus, idx", True, ctes=_WALKS)
def single_god(spark, sf):
    return score.single_god(fx.lexicons(spark, sf)).select("corpus", F.col("idx").cast("long").alias("idx"), "god")


@query("SELECT corpus, idx1, idx2, a, b FROM p", True, ctes=_PAIRS)
def word_pairs(spark, sf):
    return score.word_pairs(fx.lexicons(spark, sf)).select("corpus", F.col("idx1").cast("long").alias("idx1"), F.col("idx2").cast("long").alias("idx2"), "a", "b")


@query("SELECT corpus, idx1, idx2, god FROM prs", True, ctes=_PAIRS)
def pair_god(spark, sf):
    return _pairs(spark, sf).select("corpus", F.col("idx1").cast("int").alias("idx1"), F.col("idx2").cast("int").alias("idx2"), "god")


@query("SELECT corpus, idx1, idx2, sod, tl, god FROM prs", True, ctes=_PAIRS)
def sod_pairs(spark, sf):
    return score.sod_pairs(fx.lexicons(spark, sf)).select("corpus", F.col("idx1").cast("int").alias("idx1"), F.col("idx2").cast("int").alias("idx2"), "sod", "tl", "god")


@query(
    f"SELECT s.corpus, p.a, p.b, side, lvl, wk.w, CAST(cnt AS BIGINT) AS cnt, CAST(coalesce(o.d, -1) AS INTEGER) AS cancelled_at FROM sides s JOIN p USING (corpus, idx1, idx2) JOIN wk ON wk.corpus = s.corpus AND wk.seed = s.self LEFT JOIN dist o ON o.corpus = s.corpus AND o.seed = s.other AND o.w = wk.w WHERE s.corpus = 'ground_filtered' AND idx1 = 1 AND idx2 = 2 AND lvl <= (SELECT max(d) + 2 FROM dist WHERE corpus = 'ground_filtered')",
    True,
    ctes=_PAIRS,
)
def sod_trace(spark, sf):
    lexicon = fx.lexicons(spark, sf).where("corpus = 'ground_filtered'")
    return score.sod_trace(lexicon, F.col("idx1") == 1, F.col("idx2") == 2).withColumn("cancelled_at", F.coalesce("cancelled_at", F.lit(-1)))


@query("SELECT prs.* FROM prs JOIN vocab v USING (corpus) WHERE v.idx = 1 AND (v.idx = idx1 OR v.idx = idx2)", True, ctes=_PAIRS)
def one_vs_all(spark, sf):
    return score.one_vs_all(_pairs(spark, sf), fx.lexicons(spark, sf), F.col("idx") == 1)


# Index and spectra ----------------------------------------------------------------------------------------------------------------


@query("SELECT * FROM sym", True, ctes=_PAIRS)
def pair_index(spark, sf):
    return index.pair_index(_pairs(spark, sf))


_BINS = f"{_PAIRS}, bins AS MATERIALIZED (SELECT corpus, w, partner, sod, CAST(ntile(100) OVER (PARTITION BY corpus, w ORDER BY sod, partner) AS INTEGER) AS bin FROM sym WHERE sod > 0)"


@query("SELECT * FROM bins", True, ctes=_BINS)
def spectrum_bins(spark, sf):
    return index.spectrum(_sym(spark, sf))


@query("SELECT corpus, w, partner, sod, CAST(least(100, greatest(1, ceil(CAST(100.0 AS DOUBLE) * count(*) OVER (PARTITION BY corpus, w ORDER BY sod RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY corpus, w)))) AS INTEGER) AS pctl FROM sym WHERE sod > 0", True, ctes=_PAIRS)
def percentile_rank(spark, sf):
    return index.percentile_rank(_sym(spark, sf))


_MUTUAL = f"{_BINS}, mutual AS MATERIALIZED (SELECT x.corpus, x.bin, x.w AS a, x.partner AS b FROM bins x JOIN bins y ON x.corpus = y.corpus AND x.bin = y.bin AND x.w = y.partner AND x.partner = y.w WHERE x.w < y.w)"


@query("SELECT * FROM mutual", True, ctes=_MUTUAL)
def mutual_pairs(spark, sf):
    return index.mutual_pairs(index.spectrum(_sym(spark, sf)))


@query("SELECT corpus, bin, round(avg(n), 6) AS mean_size, round(median(n), 6) AS median_size, min(n) AS min_size, max(n) AS max_size, round(stddev_pop(n), 6) AS std_size FROM (SELECT corpus, w, bin, count(*) AS n FROM bins GROUP BY ALL) GROUP BY corpus, bin", True, ctes=_BINS)
def bin_diagnostics(spark, sf):
    return index.bin_diagnostics(index.spectrum(_sym(spark, sf)))


@query("SELECT corpus, bin, count(*) AS n, round(avg(sod), 6) AS mean_sod, round(median(sod), 6) AS median_sod, round(avg(tl), 6) AS mean_tl FROM (SELECT *, row_number() OVER (PARTITION BY corpus, bin ORDER BY a, b) AS r FROM mutual) m JOIN sym s ON s.corpus = m.corpus AND s.w = m.a AND s.partner = m.b WHERE r <= 500 GROUP BY m.corpus, bin".replace("SELECT corpus, bin, count", "SELECT m.corpus, bin, count"), True, ctes=_MUTUAL)
def start_pair_diagnostics(spark, sf):
    sym = _sym(spark, sf)
    return index.start_pair_diagnostics(index.mutual_pairs(index.spectrum(sym)), sym)


# Level coincidence and semantic difference -----------------------------------------------------------------------------------------

_WEDGE = f"""{_PAIRS}, cp AS MATERIALIZED (SELECT a.corpus, a.w AS idx_a, b.w AS idx_b, a.sod AS sod_a, b.sod AS sod_b, a.tl AS level_a, b.tl AS level_b FROM sym a JOIN sym b ON a.corpus = b.corpus AND a.partner = b.partner AND a.w < b.w),
ag AS MATERIALIZED (SELECT g.corpus, idx_a, idx_b, coalesce(s.tl, -1) AS mutual_tl, level_a, total, matching, round(CAST(100 AS DOUBLE) * matching / total, 6) AS pct FROM (SELECT corpus, idx_a, idx_b, level_a, count(*) AS total, CAST(count(*) FILTER (level_a = level_b) AS BIGINT) AS matching FROM cp GROUP BY ALL) g LEFT JOIN sym s ON s.corpus = g.corpus AND s.w = idx_a AND s.partner = idx_b),
sd AS MATERIALIZED (SELECT m.corpus, m.w AS idx_a, m.partner AS idx_b, m.tl AS mutual_sod_level, round(coalesce(s, 0), 6) AS avg_sod_diff, round(coalesce(t, 0), 6) AS avg_sod_term_diff FROM sym m LEFT JOIN (SELECT corpus, idx_a, idx_b, avg(abs(ln(1 + sod_a) - ln(1 + sod_b))) AS s, avg(abs(level_a - level_b)) AS t FROM cp GROUP BY ALL) d ON d.corpus = m.corpus AND d.idx_a = m.w AND d.idx_b = m.partner WHERE m.w < m.partner)"""


def _agreed(spark, sf):
    return fx._once("agreed", spark, sf, lambda: analysis.agreement(_sym(spark, sf)))


@query("SELECT corpus, idx_a, idx_b, level_a, level_b, count(*) AS n FROM cp GROUP BY ALL", True, ctes=_WEDGE)
def level_confusion(spark, sf):
    return analysis.level_confusion(_sym(spark, sf))


@query("SELECT * FROM ag", True, ctes=_WEDGE)
def agreement(spark, sf):
    return analysis.agreement(_sym(spark, sf))


@query(
    """SELECT c.corpus, c.idx_a, c.idx_b, c.level_a, c.level_b, coalesce(n, 0) AS n FROM (SELECT DISTINCT x.corpus, x.idx_a, x.idx_b, x.l AS level_a, y.l AS level_b FROM lv x JOIN lv y USING (corpus, idx_a, idx_b)) c
  LEFT JOIN (SELECT corpus, idx_a, idx_b, level_a, level_b, count(*) AS n FROM cp GROUP BY ALL) g USING (corpus, idx_a, idx_b, level_a, level_b)""",
    True,
    ctes=f"{_WEDGE}, lv AS MATERIALIZED (SELECT corpus, idx_a, idx_b, level_a AS l FROM cp UNION SELECT corpus, idx_a, idx_b, level_b FROM cp)",
)
def square_confusion(spark, sf):
    return analysis.square_confusion(analysis.level_confusion(_sym(spark, sf)))


@query("SELECT corpus, idx_a, idx_b, mutual_tl, level_a, total, matching FROM ag", True, ctes=_WEDGE)
def agreement_report(spark, sf):
    """Agreement written as report lines and scanned back."""
    return reports.scan_agreement(reports.agreement_lines(_agreed(spark, sf)))


@query("SELECT corpus, mutual_tl, level_a, CAST(sum(total) AS BIGINT) AS total, CAST(sum(matching) AS BIGINT) AS matching, round(CAST(100 AS DOUBLE) * sum(matching) / sum(total), 6) AS avg_pct FROM ag WHERE mutual_tl >= 0 GROUP BY ALL", True, ctes=_WEDGE)
def agreement_summary(spark, sf):
    return analysis.agreement_summary(_agreed(spark, sf))


@query("SELECT * FROM sd", True, ctes=_WEDGE)
def semantic_difference(spark, sf):
    return analysis.semantic_difference(_sym(spark, sf))


@query("SELECT corpus, mutual_sod_level, count(*) AS n, round(avg(avg_sod_diff), 5) AS mean_sod_diff, round(avg(avg_sod_term_diff), 5) AS mean_term_diff FROM sd WHERE mutual_sod_level > 0 GROUP BY ALL", True, ctes=_WEDGE)
def semantic_difference_summary(spark, sf):
    return analysis.semantic_difference_summary(analysis.semantic_difference(_sym(spark, sf)))


# Between corpora ----------------------------------------------------------------------------------------------------------------------

_ORD = ", ".join(f"('{c}', {k})" for k, c in enumerate(fx.CORPORA))
_COMBOS = f"{_COMMON}, crp(corpus, ord) AS (VALUES {_ORD}), cmb AS MATERIALIZED (SELECT x.corpus || '_vs_' || y.corpus AS combo, x.corpus AS a, y.corpus AS b FROM crp x JOIN crp y ON x.ord < y.ord)"
_UNION = f"""{_COMBOS}, ue AS MATERIALIZED (SELECT DISTINCT combo, head, tok FROM ed JOIN cmb ON ed.corpus = cmb.a OR ed.corpus = cmb.b),
ud AS (SELECT combo, word AS seed, 0 AS lvl, word AS w FROM cmb, common UNION SELECT ud.combo, seed, lvl + 1, tok FROM ud JOIN ue ON ue.combo = ud.combo AND ue.head = ud.w WHERE lvl < {DEEPEST}),
ug AS MATERIALIZED (SELECT combo, seed AS word, CAST(least(max(d) + 1, 100) AS INTEGER) AS god FROM (SELECT combo, seed, w, min(lvl) AS d FROM ud GROUP BY ALL) GROUP BY ALL)"""
_EOD = f"""{_WALKS}, {_UNION},
ew AS (SELECT corpus, head AS seed, 0 AS lvl, head AS w, CAST(1 AS HUGEINT) AS cnt FROM vocab UNION ALL
  SELECT ew.corpus, seed, lvl + 1, ed.tok, CAST(sum(mult) AS HUGEINT) FROM ew JOIN ed ON ed.corpus = ew.corpus AND ed.head = ew.w WHERE lvl < {DEEPEST} GROUP BY ew.corpus, seed, lvl, ed.tok),
es AS (SELECT combo, word, 1 AS side, a AS own, b AS against FROM cmb, common UNION ALL SELECT combo, word, 2, b, a FROM cmb, common),
ex AS MATERIALIZED (SELECT combo, word, side, ew.lvl, coalesce(o.d, 1000000) AS od, sum(cnt) AS cnt FROM es JOIN ew ON ew.corpus = es.own AND ew.seed = es.word LEFT JOIN dist o ON o.corpus = es.against AND o.seed = es.word AND o.w = ew.w GROUP BY ALL),
et AS (SELECT combo, word, min(t) AS tl FROM (SELECT combo, word, side, lvl, greatest(lvl, 1, max(od)) AS t FROM ex WHERE lvl > 0 GROUP BY combo, word, side, lvl) GROUP BY ALL),
eods AS MATERIALIZED (SELECT master_idx, word, combo, CAST(CASE WHEN tl <= god + 1 THEN sc ELSE -1 END AS BIGINT) AS eod_score, CAST(CASE WHEN tl <= god + 1 THEN tl ELSE god + 1 END AS INTEGER) AS eod_tl
  FROM (SELECT combo, word, tl, sum(CASE WHEN lvl <= tl AND od > tl THEN cnt * lvl ELSE 0 END) AS sc FROM ex JOIN et USING (combo, word) GROUP BY ALL) JOIN ug USING (combo, word) JOIN common USING (word))"""


@query("SELECT combo, word, god FROM ug", True, ctes=_UNION)
def eod_god(spark, sf):
    return score.eod_god(fx.lexicons(spark, sf), fx.corpora(spark), _common(spark, sf).select("word"))


def _eod(spark, sf):
    return fx._once("eod", spark, sf, lambda: score.eod(fx.lexicons(spark, sf), fx.corpora(spark), _common(spark, sf)))


@query("SELECT * FROM eods", True, ctes=_EOD)
def eod(spark, sf):
    return _eod(spark, sf)


_NAMES_OF_COMBOS = [f"{a}_vs_{b}" for k, a in enumerate(fx.CORPORA) for b in fx.CORPORA[k + 1 :]]


@query("SELECT master_idx, word, " + ", ".join(f"max({c}) FILTER (combo = '{n}') AS {c}_{n}" for n in _NAMES_OF_COMBOS for c in ("eod_score", "eod_tl")) + " FROM eods GROUP BY master_idx, word", True, ctes=_EOD)
def eod_wide(spark, sf):
    return reports.eod_columns(score.eod_wide(_eod(spark, sf), _NAMES_OF_COMBOS), _NAMES_OF_COMBOS)


@query("SELECT combo, count(*) AS n, round(avg(eod_score), 6) AS mean_score, round(median(eod_score), 6) AS median_score, round(avg(eod_tl), 6) AS mean_tl, round(median(eod_tl), 6) AS median_tl FROM eods WHERE eod_score > -1 GROUP BY combo", True, ctes=_EOD)
def eod_summary(spark, sf):
    return compare.eod_summary(_eod(spark, sf))


_DIFFS = f"""{_PAIRS}, {_COMBOS}, mp AS MATERIALIZED (SELECT s.corpus, x.master_idx AS m1, y.master_idx AS m2, sod, tl FROM sym s JOIN vocab a ON a.corpus = s.corpus AND a.idx = s.w JOIN common x ON x.word = a.head JOIN vocab b ON b.corpus = s.corpus AND b.idx = s.partner JOIN common y ON y.word = b.head WHERE x.master_idx < y.master_idx),
diffs AS MATERIALIZED (SELECT combo, x.m1 AS master_idx1, x.m2 AS master_idx2, x.sod - y.sod AS diff_sod, x.tl - y.tl AS diff_sod_tl FROM mp x JOIN cmb ON cmb.a = x.corpus JOIN mp y ON y.corpus = cmb.b AND x.m1 = y.m1 AND x.m2 = y.m2),
lg AS MATERIALIZED (SELECT combo, 'diff_sod' AS metric, diff_sod AS x FROM diffs UNION ALL SELECT combo, 'diff_sod_tl', diff_sod_tl FROM diffs)"""


def _diffs(spark, sf):
    return fx._once("diffs", spark, sf, lambda: compare.pairwise_diff(_sym(spark, sf), fx.lexicons(spark, sf), _common(spark, sf), fx.corpora(spark)))


@query("SELECT * FROM diffs", True, ctes=_DIFFS)
def pairwise_diff(spark, sf):
    return compare.pairwise_diff(_sym(spark, sf), fx.lexicons(spark, sf), _common(spark, sf), fx.corpora(spark))


@query("SELECT count(*) AS n_words, count(*) * (count(*) - 1) // 2 AS n_pairs FROM common", ctes=_COMMON)
def global_stats(spark, sf):
    return compare.global_stats(_common(spark, sf))


@query("SELECT combo, count(*) AS n, round(avg(diff_sod), 6) AS net_mean_sod, round(avg(diff_sod_tl), 6) AS net_mean_tl, round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) * (count(*) - 1) // 2 FROM common), 6) AS coverage_pct FROM diffs GROUP BY combo", True, ctes=_DIFFS)
def diff_net_mean(spark, sf):
    return compare.diff_net_mean(_diffs(spark, sf), _common(spark, sf))


@query("SELECT combo, metric, round(median(x), 6) AS net_median, round(avg(abs(x)), 6) AS abs_mean, round(median(abs(x)), 6) AS abs_median FROM lg GROUP BY ALL", True, ctes=_DIFFS)
def diff_stats(spark, sf):
    return compare.diff_stats(_diffs(spark, sf))


@query(
    "SELECT combo, metric, round(q1, 6) AS q1, round(q3, 6) AS q3, count(*) AS n, CAST(count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers, round(CAST(100 AS DOUBLE) * count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(*), 6) AS outlier_pct FROM (SELECT combo, metric, log10(abs(x) + 1) AS v FROM lg) JOIN (SELECT combo, metric, quantile_cont(log10(abs(x) + 1), 0.25) AS q1, quantile_cont(log10(abs(x) + 1), 0.75) AS q3 FROM lg GROUP BY ALL) USING (combo, metric) GROUP BY combo, metric, q1, q3",
    True,
    ctes=_DIFFS,
)
def diff_outliers(spark, sf):
    return compare.diff_outliers(_diffs(spark, sf))


@query("SELECT combo, metric, CAST(floor(log10(abs(x) + 1)) AS BIGINT) AS log10_bin, count(*) AS n FROM lg GROUP BY ALL", True, ctes=_DIFFS)
def log_histogram_sparse(spark, sf):
    return compare.log_histogram_sparse(_diffs(spark, sf))


@query("SELECT t.combo, t.metric, t.bin, count(l.v) AS n FROM (SELECT combo, metric, unnest(range(0, CAST(ceil(max(log10(abs(x) + 1))) AS BIGINT) + 1)) AS bin, CAST(ceil(max(log10(abs(x) + 1))) AS BIGINT) AS top FROM lg GROUP BY combo, metric) t LEFT JOIN (SELECT combo, metric, log10(abs(x) + 1) AS v FROM lg) l ON l.combo = t.combo AND l.metric = t.metric AND least(CAST(floor(l.v) AS BIGINT), t.top) = t.bin GROUP BY ALL", True, ctes=_DIFFS)
def log_histogram(spark, sf):
    return compare.log_histogram(_diffs(spark, sf))


# Walks ------------------------------------------------------------------------------------------------------------------------------------

_KEY = "corpus || '|' || start_pctl || '|{variant}|' || a || '|' || b || '|' || traj"
_CHOICE = "{pool}[1 + CAST(('0x' || substr(md5('0|' || (step + 1) || '|{side}|' || " + _KEY + "), 1, 8)) AS BIGINT) % len({pool})]"
_DEATH = "WHEN len(pa) = 0 AND len(pb) = 0 THEN 'both' WHEN len(pa) = 0 THEN 'pool_a' WHEN len(pb) = 0 THEN 'pool_b' END AS death"


def _choices(variant: str) -> str:
    return ", ".join(f"CASE WHEN death IS NULL THEN {_CHOICE.format(pool=f'p{s}', side=s, variant=variant)} END AS n{s}" for s in "ab")


def _left(items: str, used: str) -> str:
    return f"list_filter({items}, lambda x: NOT list_contains({used}, x))"


_WALK_KEYS = "corpus, start_pctl, a, b, traj"
_STEPS = f"""{_MUTUAL},
fs AS MATERIALIZED (SELECT corpus, w, list(partner ORDER BY partner) AS s FROM bins WHERE bin = 1 GROUP BY ALL),
lk AS MATERIALIZED (SELECT corpus, w, s, coalesce(l, []) AS l FROM fs LEFT JOIN (SELECT x.corpus, x.w, list(x.partner ORDER BY x.partner) AS l
  FROM bins x JOIN fs f ON f.corpus = x.corpus AND f.w = x.partner WHERE x.bin = 1 GROUP BY ALL) USING (corpus, w)),
bl AS MATERIALIZED (SELECT corpus, w, bin, list(partner ORDER BY partner) AS s FROM bins GROUP BY ALL),
st AS MATERIALIZED (SELECT corpus, bin AS start_pctl, a, b, CAST(traj AS INTEGER) AS traj FROM mutual, range(100) t(traj) WHERE bin IN {dynamics.START_PERCENTILES}),
ch AS (SELECT {_WALK_KEYS}, 0 AS step, a AS ca, b AS cb, [a] AS ua, [b] AS ub, CAST(NULL AS VARCHAR) AS death FROM st
  UNION ALL SELECT {_WALK_KEYS}, step + 1, na, nb, list_append(ua, na), list_append(ub, nb), death FROM (SELECT *, {_choices('chain')} FROM (
    SELECT *, CASE WHEN sa IS NULL OR sb IS NULL THEN 'no_bin' {_DEATH} FROM (
      SELECT ch.*, x.s AS sa, y.s AS sb, CASE WHEN len({_left('x.l', 'ub')}) > 0 THEN {_left('x.l', 'ub')} ELSE {_left('x.s', 'ub')} END AS pa,
        CASE WHEN len({_left('y.l', 'ua')}) > 0 THEN {_left('y.l', 'ua')} ELSE {_left('y.s', 'ua')} END AS pb
      FROM (SELECT * EXCLUDE (death) FROM ch WHERE death IS NULL AND step < 100) ch LEFT JOIN lk x ON x.corpus = ch.corpus AND x.w = ca LEFT JOIN lk y ON y.corpus = ch.corpus AND y.w = cb)))),
sw AS (SELECT {_WALK_KEYS}, -1 AS step, CAST(NULL AS INTEGER) AS ca, CAST(NULL AS INTEGER) AS cb, CAST([] AS INTEGER[]) AS ua, CAST([] AS INTEGER[]) AS ub, CAST(NULL AS VARCHAR) AS death FROM st WHERE start_pctl = 1
  UNION ALL SELECT {_WALK_KEYS}, step + 1, na, nb, list_append(ua, na), list_append(ub, nb), death FROM (SELECT *, {_choices('sweep')} FROM (
    SELECT *, CASE {_DEATH} FROM (
      SELECT sw.*, coalesce({_left('x.s', 'ub')}, []) AS pa, coalesce({_left('y.s', 'ua')}, []) AS pb
      FROM (SELECT * EXCLUDE (death) FROM sw WHERE death IS NULL AND step < 99) sw LEFT JOIN bl x ON x.corpus = sw.corpus AND x.w = sw.a AND x.bin = step + 2 LEFT JOIN bl y ON y.corpus = sw.corpus AND y.w = sw.b AND y.bin = step + 2)))),
pk AS MATERIALIZED (SELECT corpus, w, partner, CAST(least(100, greatest(1, ceil(CAST(100.0 AS DOUBLE) * count(*) OVER (PARTITION BY corpus, w ORDER BY sod RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY corpus, w)))) AS INTEGER) AS pctl FROM sym WHERE sod > 0),
ps AS MATERIALIZED (SELECT s.corpus, s.w, s.partner, sod, tl, coalesce(x.pctl, 1) AS pctl_a, coalesce(y.pctl, 1) AS pctl_b FROM sym s
  LEFT JOIN pk x ON x.corpus = s.corpus AND x.w = s.w AND x.partner = s.partner LEFT JOIN pk y ON y.corpus = s.corpus AND y.w = s.partner AND y.partner = s.w),
rec AS MATERIALIZED (SELECT r.corpus, start_pctl, variant, a, b, traj, step, sod, tl, coalesce(pctl_a, -1) AS pctl_a, coalesce(pctl_b, -1) AS pctl_b, death,
  lag(sod) OVER (PARTITION BY r.corpus, start_pctl, variant, a, b, traj ORDER BY step) AS prev_sod
  FROM (SELECT {_WALK_KEYS}, 'chain' AS variant, step, ca, cb, death FROM ch UNION ALL SELECT {_WALK_KEYS}, 'sweep', step, ca, cb, death FROM sw WHERE step >= 0) r
  LEFT JOIN ps ON ps.corpus = r.corpus AND ps.w = ca AND ps.partner = cb)"""


def _steps(spark, sf):
    def make():
        sym = _sym(spark, sf)
        bins = index.spectrum(sym)
        ranked = sym.join(index.percentile_rank(sym).select("corpus", "w", "partner", "pctl"), ["corpus", "w", "partner"], "left")
        return dynamics.walk(dynamics.start_pairs(index.mutual_pairs(bins), 100), bins, ranked, max_steps=100)

    return fx._once("steps", spark, sf, make)


def _moment(value: str, name: str) -> str:
    return f"round(coalesce(sum({value}), 0.0), 6) AS {name}_sum, round(coalesce(sum(({value}) * ({value})), 0.0), 6) AS {name}_sq_sum"


_WENT = {c: f"CASE WHEN death IS NULL{' AND ' + c + ' >= 0' if 'pctl' in c else ''} THEN CAST({c} AS DOUBLE) END" for c in ("sod", "tl", "pctl_a", "pctl_b")}
_LOG = "CASE WHEN death IS NULL AND sod > 0 THEN ln(CAST(sod AS DOUBLE)) END"
_DELTA = f"({_WENT['sod']}) - CAST(prev_sod AS DOUBLE)"


@query(
    "SELECT corpus, start_pctl, variant, step, CAST(count(*) FILTER (death IS NULL) AS BIGINT) AS count, "
    + ", ".join([
        *(_moment(v, c) for c, v in _WENT.items()),
        f"round(coalesce(sum(({_WENT['sod']}) * ({_WENT['tl']})), 0.0), 6) AS sod_tl_sum",
        f"round(coalesce(sum(({_WENT['pctl_a']}) * ({_WENT['pctl_b']})), 0.0), 6) AS pctl_ab_sum",
        _moment(_LOG, "log_sod"), _moment(_DELTA, "delta_sod"), f"count({_DELTA}) AS delta_sod_count",
        *(f"CAST(count(*) FILTER (death = '{d}') AS BIGINT) AS death_{d}" for d in ("pool_a", "pool_b", "both", "no_bin")),
    ])
    + " FROM rec GROUP BY corpus, start_pctl, variant, step",
    True,
    ctes=_STEPS,
)
def dynamics_stats(spark, sf):
    out = dynamics.dynamics_stats(_steps(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_sum") else F.col(c) for c in out.columns])


_EDGES = "[" + ", ".join(f"CAST('{e!r}' AS DOUBLE)" for e in dynamics.SOD_EDGES) + "]"


@query(
    f"""SELECT corpus, start_pctl, variant, step, hist_type, CAST(bin_idx AS INTEGER) AS bin_idx, count(*) AS bin_count FROM (
  SELECT corpus, start_pctl, variant, step, 'tl' AS hist_type, least(tl, {dynamics.MAX_TL}) AS bin_idx FROM rec WHERE death IS NULL AND sod IS NOT NULL
  UNION ALL SELECT corpus, start_pctl, variant, step, 'pctl_a', pctl_a FROM rec WHERE death IS NULL AND sod IS NOT NULL AND pctl_a >= 1
  UNION ALL SELECT corpus, start_pctl, variant, step, 'pctl_b', pctl_b FROM rec WHERE death IS NULL AND sod IS NOT NULL AND pctl_b >= 1
  UNION ALL SELECT corpus, start_pctl, variant, step, 'sod', least(len(list_filter({_EDGES}, lambda e: e <= sod)) - 1, {len(dynamics.SOD_EDGES) - 2}) FROM rec WHERE death IS NULL AND sod IS NOT NULL
  UNION ALL SELECT corpus, start_pctl, variant, -1, 'walk_len', count(*) FILTER (death IS NULL) FROM rec GROUP BY corpus, start_pctl, variant, a, b, traj) GROUP BY ALL""",
    True,
    ctes=_STEPS,
)
def dynamics_hist(spark, sf):
    return dynamics.dynamics_hist(_steps(spark, sf))


# Text ---------------------------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT regexp_extract(i, 'href=\"([^\"]*)\"', 1) AS target, regexp_extract(i, '>([^<]*)</a>', 1) AS label FROM (SELECT unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">[^<]*</a></li>')) AS i FROM pages)", closed=False)
def page_links(spark, sf):
    return text.page_links(spark.read.parquet(f"{sf}/pages.parquet").select("html"))


#: Entry pages made of the benchmark's texts: definition spans, page descriptions, neither; with and without markers of categories.
_ENTRIES = """pg AS (SELECT item_id AS page_id, CASE WHEN item_id % 7 = 6 THEN 'two words' ELSE 'word' END AS entry,
  '<title>x</title>' || CASE item_id % 5 WHEN 0 THEN '<i id="toc-Noun"></i>' WHEN 1 THEN '<a title="number"></a><i id="toc-Noun"></i>' WHEN 2 THEN '<a href="/wiki/Category:Proper_nouns"></a><i id="toc-Noun"></i>' WHEN 3 THEN '<a>Category:Verbs</a>' ELSE '' END
  || CASE item_id % 4 WHEN 0 THEN '<span class="dtText"><strong>: </strong>' || text || '&nbsp;&amp; <b>more</b></span>'
    WHEN 1 THEN '<meta name="description" content="The meaning of WORD is ' || text || '. How to use it.">' WHEN 2 THEN '<p>' || text || '</p>'
    ELSE '<span class="dtText">: a suffix of ' || text || '</span>' END AS html FROM benchmark),
d AS (SELECT page_id, entry, CASE WHEN regexp_matches(html, '(?s)<span class="dtText">.*?</span>') THEN trim(regexp_replace(trim(replace(replace(regexp_replace(regexp_extract(html, '(?s)<span class="dtText">(.*?)</span>', 1), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&')), '^:\\s*', ''))
  WHEN regexp_matches(html, '<meta name="description" content="[^"]*"') THEN split_part(regexp_replace(regexp_extract(html, '<meta name="description" content="([^"]*)"', 1), '(?s)^.*? is ', ''), '. How to use', 1) END AS definition, html FROM pg)"""


def _entries(spark, sf):
    k, words, lit = F.col("item_id"), F.col("text"), F.lit
    noun = '<i id="toc-Noun"></i>'
    marks = F.when(k % 5 == 0, noun).when(k % 5 == 1, f'<a title="number"></a>{noun}').when(k % 5 == 2, f'<a href="/wiki/Category:Proper_nouns"></a>{noun}')
    marks = marks.when(k % 5 == 3, "<a>Category:Verbs</a>").otherwise("")
    body = F.when(k % 4 == 0, F.concat(lit('<span class="dtText"><strong>: </strong>'), words, lit("&nbsp;&amp; <b>more</b></span>")))
    body = body.when(k % 4 == 1, F.concat(lit('<meta name="description" content="The meaning of WORD is '), words, lit('. How to use it.">')))
    body = body.when(k % 4 == 2, F.concat(lit("<p>"), words, lit("</p>"))).otherwise(F.concat(lit('<span class="dtText">: a suffix of '), words, lit("</span>")))
    entry = F.when(k % 7 == 6, "two words").otherwise("word")
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(k.alias("page_id"), entry.alias("entry"), F.concat(lit("<title>x</title>"), marks, body).alias("html"))


@query("SELECT page_id, definition FROM d", closed=False, ctes=_ENTRIES)
def html_definition(spark, sf):
    return _entries(spark, sf).select("page_id", text.html_definition(F.col("html")).alias("definition"))


def _like(column: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


_REASON = f"""CASE WHEN NOT regexp_full_match(entry, '[a-z]+') THEN 'invalid_format'
  WHEN {_like('lower(html)', text.NUMBER_MARKERS)} OR {_like('lower(html)', text.PROPER_MARKERS)} OR NOT {_like('lower(html)', text.ALLOWED_MARKERS)} THEN 'not_allowed_category'
  WHEN coalesce(definition, '') = '' THEN 'empty_definition' WHEN regexp_matches(lower(definition), '\\bsuffix\\b') THEN 'is_suffix' ELSE 'success' END"""


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM d) GROUP BY reason", closed=False, ctes=_ENTRIES)
def entry_reasons(spark, sf):
    """Reasons by which entries are kept or left out."""
    reason = text.entry_reason(F.col("entry"), F.col("html"), text.html_definition(F.col("html")))
    return _entries(spark, sf).select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'word' ELSE split_part(text, ' ', 1) END AS form, 'x ' || split_part(text, ' ', 2) || ' y ' || split_part(text, ' ', 3) AS formula FROM benchmark",
    closed=False,
)
def entry_texts(spark, sf):
    """Forms that entries point to, and formulas as text."""
    k, words = F.col("item_id"), F.split("text", " ")
    form = F.when(k % 3 == 0, F.lit("what?")).otherwise(words[0])
    page = F.concat(F.lit("<p><i>no</i></p><ol><li>past tense of (see <i>no</i>) <i>which?</i> <i class='m'><b>"), form, F.lit("</b></i><dl><i>no</i></dl></li></ol>"))
    span = '<span class="mwe-math-mathml-inline mwe-math"><math>no</math></span>'
    image = '<img alt="{alt}" class="mwe-math-fallback-image-inline" src="x">'
    plain = '<img class="mwe-math-fallback-image-inline" alt="{alt}">'
    before, after = image.split("{alt}"), plain.split("{alt}")
    formula = F.concat(F.lit(f"x {span}{before[0]}{{\\displaystyle "), words[1], F.lit(f"}}{before[1]} y {after[0]}"), words[2], F.lit(after[1]))
    rows = spark.read.parquet(f"{sf}/benchmark.parquet")
    return rows.select("item_id", text.final_form(F.lit("word"), page).alias("form"), text.without_math(formula).alias("formula"))


@query("SELECT c_custkey AS custkey, 'http://a.b/w/' || replace(replace(c_name, '#', '%23'), ' ', '%20') || '%2F~%2A' AS url, 'http://a.b/w/i?from=' || c_custkey || '&x' AS following FROM customer", closed=False)
def page_urls(spark, sf):
    """Addresses of words, and of the pages that follow index pages."""
    name = text.quoted(F.concat("c_name", F.lit("/~*")))
    nav = F.concat(F.lit('<div class="n mw-allpages-nav"><a href="p">Previous page</a> | <a href="/w/i?from='), F.col("c_custkey").cast("string"), F.lit('&amp;x" title="t">Next page (b)</a></div>'))
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("custkey"), text.joined_url(F.lit("http://a.b/w/x?y"), name).alias("url"), text.next_page(F.lit("http://a.b/w/i?from=0"), nav).alias("following"))


@query("SELECT item_id, 'w' || item_id AS word, text AS definition FROM benchmark", closed=False)
def json_definitions(spark, sf):
    """Replies made of the benchmark's texts, parsed back."""
    rows = spark.read.parquet(f"{sf}/benchmark.parquet")
    reply = F.concat(F.lit("Here it is:\n"), F.to_json(F.array(F.struct(F.concat(F.lit("w"), F.col("item_id").cast("string")).alias("word"), F.col("text").alias("definition")))), F.lit("\ndone"))
    return rows.select("item_id", F.explode(text.json_definitions(reply)).alias("x")).select("item_id", "x.word", "x.definition")


_NAMES = "nm AS (SELECT c_name AS word FROM customer)"


def _length_sql() -> str:
    total, cols = sum(s for _, s in LENGTH_SHARES), []
    for length, share in LENGTH_SHARES:
        cols.append(f"CAST(round_even(n * {share} / CAST({total} AS DOUBLE), 0) AS BIGINT) AS c{length}")
    ends, run = [], []
    for length, _ in LENGTH_SHARES:
        run.append(f"c{length}")
        ends.append(f"WHEN k < {' + '.join(run)} THEN {length}")
    return f"asg AS MATERIALIZED (SELECT word, CASE {' '.join(ends)} ELSE 4 END AS length FROM (SELECT word, row_number() OVER (ORDER BY md5('42|' || word), word) - 1 AS k FROM nm), (SELECT {', '.join(cols)} FROM (SELECT count(*) AS n FROM nm)))"


def _assigned(spark, sf):
    words = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_name").alias("word"))
    return text.length_assignment(words, LENGTH_SHARES)


@query("SELECT * FROM asg", closed=False, ctes=f"{_NAMES}, {_length_sql()}")
def length_assignment(spark, sf):
    return _assigned(spark, sf)


@query("SELECT length, count(*) AS n_words, CAST(ceil(count(*) / 100.0) AS BIGINT) AS n_batches, CAST(count(*) * (length + 15) AS BIGINT) AS output_tokens FROM asg GROUP BY length", closed=False, ctes=f"{_NAMES}, {_length_sql()}")
def length_plan(spark, sf):
    return text.length_plan(_assigned(spark, sf))


@query("SELECT length, batch, count(*) AS n, '[\"' || string_agg(word, '\",\"' ORDER BY word) || '\"]' AS request FROM (SELECT *, (row_number() OVER (PARTITION BY length ORDER BY word) - 1) // 100 AS batch FROM asg) GROUP BY length, batch", closed=False, ctes=f"{_NAMES}, {_length_sql()}")
def batches(spark, sf):
    return text.batches(_assigned(spark, sf))


@query("SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')", closed=False)
def resume_todo(spark, sf):
    """Customers that no urgent order has touched yet."""
    work = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    return source.resume_todo(work, spark.read.parquet(f"{sf}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey")), "custkey")
