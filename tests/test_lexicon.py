"""Lexicon operators against a level-by-level simulation on small random lexicons, and against SQL on the smallest tables."""

from __future__ import annotations

import os
import random
from collections import Counter
from unittest.mock import MagicMock

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.operators import analysis, curate, dynamics, index, partners, score, tiles
from lexweave.plans import catalog, reports
from lexweave.plans.pipeline import Workspace
from lexweave.sources import lexicon as source

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def reach(seeds, graph):
    seen, front, level = set(seeds), set(seeds), 0
    while True:
        level += 1
        front = {t for w in front for t in graph.get(w, [])} - seen
        if not front or level == 100:
            return level
        seen |= front


def expand(a, b, first, second, omega, multiply=True, start=0):
    """Both sides grow level by level; words that the other side has ever reached leave all levels."""
    levels, met = ([Counter([a])], [Counter([b])]), ({a}, {b})
    for level in range(1, omega + 2):
        for side, graph in ((0, first), (1, second)):
            new = Counter()
            for w, n in levels[side][-1].items():
                for t in graph.get(w, []):
                    new[t] += n if multiply else 1
            levels[side].append(new)
            met[side].update(new)
        left = [[{w: n for w, n in c.items() if w not in met[1 - s]} for c in levels[s]] for s in (0, 1)]
        if any(not c for s in (0, 1) for c in left[s][start:]):
            return sum(k * n for s in (0, 1) for k, c in enumerate(left[s]) for n in c.values()), level
    return -1, omega + 1


def random_lexicon(seed, n=9):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(n)]
    return {w: [r.choice(words) for _ in range(r.randint(1, 3))] for w in words}


def frame(spark, lexicons):
    rows = [(c, k + 1, w, d) for c, lex in lexicons.items() for k, (w, d) in enumerate(lex.items())]
    return spark.createDataFrame(rows, "corpus string, idx int, head string, definition array<string>")


def test_pairs_match_simulation(spark):
    lexicons = {f"c{k}": random_lexicon(k) for k in range(6)}
    got = {(r.corpus, r.idx1, r.idx2): (r.sod, r.tl, r.god) for r in score.sod_pairs(frame(spark, lexicons)).collect()}
    for c, lex in lexicons.items():
        words = list(lex)
        for i, a in enumerate(words):
            for j in range(i + 1, len(words)):
                god = reach([a, words[j]], lex)
                assert got[c, i + 1, j + 1] == (*expand(a, words[j], lex, lex, god), god)


def test_eod_matches_simulation(spark):
    lexicons = {f"c{k}": random_lexicon(k + 50) for k in range(4)}
    del lexicons["c3"]["w8"]
    lexicons["c3"] = {w: [t for t in d if t != "w8"] or ["w0"] for w, d in lexicons["c3"].items()}
    corpora = spark.createDataFrame([(f"c{k}", k) for k in range(4)], "corpus string, ord int")
    words = spark.createDataFrame([(k, f"w{k}") for k in range(9)], "master_idx int, word string")
    got = {(r.word, r.combo): (r.eod_score, r.eod_tl) for r in score.eod(frame(spark, lexicons), corpora, words).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            x, y = lexicons[f"c{i}"], lexicons[f"c{j}"]
            both = {w: x.get(w, []) + y.get(w, []) for w in {*x, *y}}
            for w in (f"w{k}" for k in range(9)):
                want = expand(w, w, x, y, reach([w], both), False, 1) if w in x and w in y else (-2, -2)
                assert got[w, f"c{i}_vs_c{j}"] == want


def test_prune_drops_dangling_and_is_idempotent(spark):
    lex = frame(spark, {"c": {"a": ["b", "x"], "b": ["a", "a"], "d": ["x"], "e": ["d", "b"], "f": ["d"]}})
    closed = curate.self_contained(lex)
    assert {r.head: r.definition for r in closed.collect()} == {"a": ["b"], "b": ["a", "a"], "e": ["b"]}
    assert {r.head: r.definition for r in curate.self_contained(closed).collect()} == {"a": ["b"], "b": ["a", "a"], "e": ["b"]}
    assert {r.tok: r.n for r in curate.dangling_counts(lex).collect()} == {"x": 2, "d": 2}
    assert {r["head"] for r in curate.removed_headwords(lex).collect()} == {"d", "f"}


def test_a_corpus_that_closes_to_nothing_shares_no_word(spark):
    raw = frame(spark, {"c": {"a": ["b"], "b": ["a"]}, "d": {"a": ["b"], "b": ["a"]}, "e": {"a": ["x"]}})
    closed = curate.self_contained(raw)
    assert score.common_vocabulary(closed, 3).count() == 0
    assert [(r.master_idx, r.word) for r in score.common_vocabulary(closed, 2).orderBy("master_idx").collect()] == [(0, "a"), (1, "b")]


def test_parse_keeps_first_place_and_last_definition(spark):
    lines = [(1, "  B : x  y "), (2, "no colon"), (3, "a: b: c"), (4, ""), (5, "b: z"), (6, "e:")]
    got = source.parse_lexicon(spark.createDataFrame([("c", *x) for x in lines], "corpus string, line_no long, line string")).orderBy("idx").collect()
    assert [(r.idx, r.head, r.definition) for r in got] == [(1, "b", ["z"]), (2, "a", ["b:", "c"]), (3, "e", [])]


def test_lexicon_text_round_trip(spark, tmp_path):
    lex = frame(spark, {"c": random_lexicon(3)})
    source.write_lexicon(lex, str(tmp_path / "lex"))
    assert sorted(map(str, source.read_lexicon(spark, str(tmp_path / "lex"), "c").collect())) == sorted(map(str, lex.collect()))


def test_bins_and_ranks(spark):
    rows = [("c", 1, p, 1 + p % 7, 1) for p in range(2, 240)] + [("c", 1, 500, 0, 1)]
    pairs = spark.createDataFrame(rows, "corpus string, w int, partner int, sod long, tl int")
    sizes = [r.n for r in index.spectrum(pairs).groupBy("bin").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 100 and sum(sizes) == 238 and max(sizes) - min(sizes) <= 1
    ranks = [r.pctl for r in index.percentile_rank(pairs).collect()]
    assert min(ranks) >= 1 and max(ranks) == 100


def test_walks_keep_their_rules(spark):
    lexicons = {"c": random_lexicon(5, 14)}
    pairs = score.sod_pairs(frame(spark, lexicons))
    sym = index.pair_index(pairs)
    bins = index.spectrum(sym)
    ranked = sym.join(index.percentile_rank(sym).select("corpus", "w", "partner", "pctl"), ["corpus", "w", "partner"], "left")
    steps = dynamics.walk(dynamics.start_pairs(index.mutual_pairs(bins), 2), bins, ranked, max_steps=4).cache()
    assert steps.count()
    stats, hist = dynamics.dynamics_stats(steps), dynamics.dynamics_hist(steps)
    assert stats.agg(F.sum("count")).first()[0] == steps.where("death IS NULL").count()
    walks = steps.select(*dynamics.KEYS).distinct().count()
    assert hist.where("hist_type = 'walk_len'").agg(F.sum("bin_count")).first()[0] == walks
    assert steps.where("step > 4 AND variant = 'chain'").count() == 0


def test_registered_walks_are_the_whole_job(monkeypatch):
    asked = {}
    for f in ("spectrum", "mutual_pairs", "percentile_rank"):
        monkeypatch.setattr(catalog.index, f, MagicMock())
    monkeypatch.setattr(catalog, "_sym", MagicMock())
    monkeypatch.setattr(catalog.fx, "_once", lambda name, spark, sf, make: make())
    monkeypatch.setattr(catalog.dynamics, "start_pairs", lambda mutual, trajectories: asked.update(trajectories=trajectories))
    monkeypatch.setattr(catalog.dynamics, "walk", lambda starts, bins, ranked, max_steps=100: asked.update(max_steps=max_steps))
    catalog._steps(None, SF)
    assert asked == {"trajectories": 100, "max_steps": 100}


def test_empty_tables(spark):
    none = frame(spark, {"c": {"a": ["b"]}}).where("false")
    assert score.sod_pairs(none).count() == 0 and score.single_god(none).count() == 0 and curate.self_contained(none).count() == 0


def test_text_functions(spark):
    rows = [('<span class="dtText">: a <b>big</b>&nbsp;dog &amp; cat</span>',), ('<meta name="description" content="The meaning of X is a thing. How to use X">',), ("<p>none</p>",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(text.html_definition(F.col("h"))).collect()]
    assert got == ["a big dog & cat", "a thing", None]
    page = spark.createDataFrame([("a def<dl>x", "Plural of dog.", "be a2 Dogs. dog big's x", "dog")], "h string, t string, w string, e string")
    r = page.select(text.cut_at_markers(F.col("h")), text.is_form_redirect(F.col("t")), text.unique_tokens(text.definition_tokens(F.col("w")), F.col("e"))).first()
    assert r[0] == "a def" and r[1] and r[2] == ["dogs", "bigs"]


def test_workspace_runs_and_resumes(spark, tmp_path):
    work = Workspace(spark, f"file://{tmp_path}")
    lexicons = {f"c{k}": random_lexicon(k + 20, 6) for k in range(2)}
    work.curate(frame(spark, lexicons))
    work.run_analysis()
    work.run_eod(spark.createDataFrame([("c0", 0), ("c1", 1)], "corpus string, ord int"))
    status = work.status()
    assert status["pairs"] == 30 and status["eod"] == 6 and status["steps"] is None
    assert work.run_od().count() == 30


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    plain = lambda rows: sorted(tuple("" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)
    assert plain(got.select(order).collect()) == plain(want[order].astype(object).where(want[order].notna(), None).itertuples(index=False, name=None))


def test_tiles_of_any_size_give_the_same_scores(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{k}" for k in range(23)]
    lexicon = {"x": {w: r.choices(words, k=r.randint(1, 4)) for w in words}}
    whole = sorted(map(tuple, score.sod_pairs(frame(spark, lexicon)).collect()))
    monkeypatch.setattr(tiles, "SIDE", 5)
    assert sorted(map(tuple, score.sod_pairs(frame(spark, lexicon)).collect())) == whole and len(whole) == 23 * 22 // 2
    some = spark.createDataFrame([x[:3] for x in whole[::7]], "corpus string, idx1 int, idx2 int")
    assert sorted(map(tuple, score.sod_pairs(frame(spark, lexicon), some).collect())) == whole[::7]


def test_scores_beyond_floating_point_stay_exact():
    # a chain that multiplies walks by 2 ** 12 a step, against a lone word that loops
    names = {w: k for k, w in enumerate("abcdefg")}
    chain = [(x, [y] * 4096) for x, y in zip("abcde", "bcdef", strict=True)] + [("f", ["f"]), ("g", ["g"])]
    graph = tiles.Graph(names, chain)
    one, two = np.array([0]), np.array([5])
    assert [x.tolist() for x in tiles.tile(graph, one, two)] == [x.tolist() for x in tiles.tile(graph, one, two, object)]
    graph = tiles.Graph(names, [*chain[:-1], ("g", ["a"])])
    assert tiles.tile(graph, np.array([6]), two)[0].tolist() == tiles.tile(graph, np.array([6]), two, object)[0].tolist()


def test_common_partners_by_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(partners, "SIDE", 3)
    r = random.Random(6)
    tl = {(a, b): r.randint(0, 3) for a in range(1, 12) for b in range(1, 12) if a < b and r.random() < 0.8}
    rows = [("x", w, p, 10 * w * p, t) for (a, b), t in tl.items() for w, p in ((a, b), (b, a))]
    found = spark.createDataFrame(rows, "corpus string, w int, partner int, sod long, tl int")
    level, want = {(w, p): t for _, w, p, _, t in rows}, {}
    for a in range(1, 12):
        for b in range(a + 1, 12):
            for p in range(1, 12):
                if (a, p) in level and (b, p) in level:
                    key = (a, b, level[a, p], level[b, p])
                    want[key] = want.get(key, 0) + 1
    got = analysis.level_confusion(found)
    assert {(x.idx_a, x.idx_b, x.level_a, x.level_b): x.n for x in got.collect()} == want
    agreed = {(x.idx_a, x.idx_b, x.level_a): (x.total, x.matching) for x in analysis.agreement(found).collect()}
    for (a, b, la), (total, matching) in agreed.items():
        assert total == sum(n for (x, y, l, _), n in want.items() if (x, y, l) == (a, b, la)) and matching == want.get((a, b, la, la), 0)
    assert analysis.agreement(found.where("false")).count() == 0


def test_eod_file_and_report(spark, tmp_path):
    table = spark.createDataFrame([(0, "a", "x_vs_y", 5, 1), (0, "a", "x_vs_z", -2, -2)], "master_idx int, word string, combo string, eod_score long, eod_tl int")
    reports.write_eod(table, ["x_vs_y", "x_vs_z"], f"{tmp_path}/eod")
    back = spark.read.csv(f"{tmp_path}/eod", header=True)
    assert back.columns == ["master_idx", "word", "eod_score_x_vs_y", "eod_tl_x_vs_y", "eod_score_x_vs_z", "eod_tl_x_vs_z"] and back.first()[2] == "5"
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(["Mutual Termination Level: -1", "--- Agreement Analysis Results ---", "head", "2 10 4 40.00", "bad", "-" * 34, "3 1 1", "Mutual Termination Level: 5", "--- Agreement Analysis Results ---", "1 2 0"])], "file string, line_no int, line string")
    got = reports.scan_agreement(lines, ("file",)).collect()
    assert sorted((x.mutual_tl, x.level_a, x.total, x.matching) for x in got) == [(-1, 2, 10, 4), (5, 1, 2, 0)]
    assert reports.titled("mean_sod_diff") == "Mean Sod Diff"


#: Queries whose SQL counts walks, and so ends at catalog.DEEPEST levels.
WALKED = "single_god pair_god sod_pairs one_vs_all pair_index percentile_rank level_confusion agreement agreement_report agreement_summary semantic_difference semantic_difference_summary dynamics_stats dynamics_hist".split()


@pytest.fixture(scope="module")
def ring(tmp_path_factory):
    """Tables of one lexicon: a ring of 40 words, each linked to the next 20 times and to five others once."""
    folder, con = tmp_path_factory.mktemp("ring"), duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'w ' || i AS p_name FROM range(40) t(i)")
    con.execute("CREATE TABLE lineitem AS SELECT 'N' AS l_returnflag, h AS l_partkey, (h + step) % 40 AS l_suppkey, h * 1000 + step * 20 + c AS l_orderkey, 1 AS l_linenumber FROM range(40) t(h), range(1, 7) u(step), range(20) v(c) WHERE step = 1 OR c = 0")
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", WALKED)
def test_a_lexicon_deeper_than_its_sql_is_followed_to_its_end(spark, ring, name):
    folder, con = ring
    got = catalog.QUERIES[name](spark, folder)
    order = sorted(got.columns)
    plain = lambda rows: sorted(tuple(str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)
    sql = f"SELECT {', '.join(order)} FROM ({catalog.SQL[name]})"
    deeper = sql.replace(f"lvl < {catalog.DEEPEST}", "lvl < 100")
    rows = plain(got.select(order).collect())
    assert rows == plain(con.execute(deeper).fetchall())
    assert (rows == plain(con.execute(sql).fetchall())) == (catalog.DEEPEST > 40)


def test_levels_of_a_ring_match_simulation(spark, ring):
    lex = {f"w{k}": [f"w{(k + 1) % 40}"] for k in range(40)}
    assert {r.god for r in catalog.QUERIES["single_god"](spark, ring[0]).collect()} == {reach(["w0"], lex)} == {40}
    got = {(r.idx1, r.idx2): (r.sod, r.tl, r.god) for r in catalog.QUERIES["sod_pairs"](spark, ring[0]).collect()}
    for i in range(40):
        for j in range(i + 1, 40):
            god = reach([f"w{i}", f"w{j}"], lex)
            assert got[i + 1, j + 1] == (*expand(f"w{i}", f"w{j}", lex, lex, god), god)
    assert len(got) == 780 and max(tl for _, tl, _ in got.values()) == 20
