import os

import pytest

from notelake.llm import mapping as M

NAMES = [(1, "Inventory glossary"), (2, "Payment scheduling"), (3, "Backup provisioning"), (4, "Search limiting"), (5, "Search limiting on mobile"), (6, "Rate forecast"), (7, "Seltunzo"), (7, "Project Fatodadu"), (8, "Cache rotation")]
SAME = [
    ("inventory GLOSSARY", 1), ("Invent0ry glosary", 1), ("Inventory  glossary...", 1), ("Ｉｎｖｅｎｔｏｒｙ ｇｌｏｓｓａｒｙ", 1), ("Invеntory glossаry", 1), ("Inven­tory gloss​ary", 1), ("Inventory glossary#Overview", 1),
    ("scheduling, Paymeent", 2), ("Payment-scheduling", 2), ("re: WIP Payment scheduling", 2), ("# Payment schedulng", 2), ("PaymentScheduling", 2), ("Paymen tscheduling", 2),
    ("provisioning of backups", 3), ("Backup provisioni", 3), ("Bákup provisioning page", 3), ("search limiting v2", 4), ("Search limiting on mobil", 5), ("Rate forcast (draft)", 6), ("seltunzo", 7), ("project-fatodadu", 7), ("Seltunzo", 7),
]
OTHER = ["Payment limiting", "Cache glossary", "Xasizel rotation", "Search", "README", "Why rozosu and not nidaro 93191167", "rotation", "โน้ต", "!!", "9999"]


def ask(spark, values, names=NAMES, **kw):
    df = spark.createDataFrame([(v, 1) for v in values], "value string, n bigint")
    mapped, every = M.map_values(df, spark.createDataFrame(names, "id int, name string"), **kw)
    return {r["value"]: r["id"] for r in mapped.collect()}, every


def test_ways_of_typing(spark):
    got, every = ask(spark, [v for v, _ in SAME] + OTHER)
    assert got == dict(SAME)
    assert every.count() == len(SAME) + len(OTHER)


def test_a_list_too_long_to_hold_gives_the_same(spark):
    values = [v for v, _ in SAME] + OTHER
    kw = {"held": 2}
    got, every = ask(spark, values, **kw)
    assert got == dict(SAME) and every.count() == len(values)
    assert ask(spark, ["x y"], NAMES[:1], held=0)[0] == {} and ask(spark, [], NAMES, **kw)[0] == {}


def test_numbers_at_the_end(spark):
    got, _ = ask(spark, ["Rate forecast 2024", "Rate forecast v12", "Rate forecast (final v7)"])
    assert set(got.values()) == {6} and len(got) == 3
    assert ask(spark, ["Plan 2024", "Plan 2025"], [(1, "Plan 2024"), (2, "Plan 2025")])[0] == {"Plan 2024": 1, "Plan 2025": 2}


def test_empty(spark):
    assert ask(spark, ["x y"], [])[0] == {} and ask(spark, [])[0] == {}


def test_ties_go_to_the_smaller_id(spark):
    assert ask(spark, ["Cache rotatio"], [(9, "Cache rotation"), (8, "Cache rotation")])[0] == {"Cache rotatio": 8}


def test_filters_lose_nothing(spark):
    """The join against all pairs whose exact Jaccard similarity suffices."""
    import random

    rng = random.Random(5)
    words = [w for _, n in NAMES for w in n.split()]
    values = []
    for _ in range(300):
        s = list(" ".join(rng.sample(words, rng.choice([1, 2, 2, 3]))))
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice("abcdefgh ")
        values.append("".join(s).strip() or "x")
    entries = sorted({(i, M.fold(n)) for i, n in NAMES})
    known = frozenset(w for _, n in entries for w in n.split())
    want = {}
    for v in set(values):
        f = M.fold(v)
        mine, best = set(M.pairs_of(f)), None
        for i, n in entries:
            e = set(M.pairs_of(n))
            j = len(mine & e) / len(mine | e) if mine | e else 0
            if j >= M.SIMILARITY and (d := M.means(f, n, known)) is not None:
                best = min(best or (99,), (-j, d, i))
        if best:
            want[v] = best[2]
    assert ask(spark, sorted(set(values)))[0] == want


@pytest.mark.parametrize("a, b, d", [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "abcd", 1), ("abc", "xyz", 3), ("", "ab", 2)])
def test_edits(a, b, d):
    assert M.edits(a, b, 5) == d and M.edits(a, b, 0) == min(d, 1)


@pytest.mark.parametrize("heavy_rows", [1, 3, 10**9])
def test_rows(spark, save, monkeypatch, heavy_rows):
    monkeypatch.setattr(M.with_mapping, "__defaults__", (heavy_rows, 2))
    links = [(k, "v", " Cache rotaton ") for k in range(9)] + [(20, "v", "Cache rotation"), (21, "v", "home/Cache rotaton"), (22, "v", None), (23, "v", "  "), (24, "v", "README"), (25, "v", "Cachee rotation"), (25, "v", "Cachee rotation"), (None, "v", "ROTATION OF CACHES")]
    folder = save(
        wiki_links=([(*x, 1, "q") for x in links], "link_id bigint, vault string, target string, value int, id string"),
        note_updates=([(1, "cache rotation", 7), (2, None, 7)], "update_id bigint, title string, n int"),
        topics=([(8, "Cache rotation", ["Zeldrerenli", None]), (None, "Nobody", None), (9, None, None)], "topic_id int, title string, aka array<string>"),
        vaults=([("home",)], "name string"),
    )
    got = sorted((r["src"], r["rec_id"] if r["rec_id"] is not None else -1, r["topic_id"]) for r in M.p2_found(spark, folder).collect())
    assert got == [("note_updates", 1, 8)] + [("wiki_links", k, 8) for k in (-1, *range(9), 25, 25)]
    assert [(r["value"], r["n"]) for r in M.p2_unmatched(spark, folder).collect()] == [("README", 1)]


def test_values_with_a_vault_name_are_reported(spark, save):
    links = ["home/README", "home/README", " home/ Why rozosu ", "home/Cache rotation", "home/ROTATION OF CACHES", "home/", "away/README", "home/sub/README", "Cache rotaton", "Cache rotation", "/x", "README"]
    folder = save(
        wiki_links=(list(enumerate(links)), "link_id bigint, target string"),
        note_updates=([(1, "home/README")], "update_id bigint, title string"),
        topics=([(8, "Cache rotation", None)], "topic_id int, title string, aka array<string>"),
        vaults=([("home",), (None,)], "name string"),
    )
    got = {r["value"]: r["n"] for r in M.p2_unmatched(spark, folder).collect()}
    assert got == {"home/README": 3, "home/ Why rozosu": 1, "home/": 1, "away/README": 1, "home/sub/README": 1, "/x": 1, "README": 1}
    assert [r["rec_id"] for r in M.p2_found(spark, folder).collect()] == [8]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_whole_tables(spark):
    assert M.p2_found(spark, "/root/testdata/sf0.001").count() > 20
