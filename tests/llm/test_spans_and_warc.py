import random
import re
from datetime import datetime, timedelta

import duckdb
import pytest

from fernweave.llm import span_dedup as D
from fernweave.llm import warc as W

SHAPE = "doc_id bigint, text string, at int, gone string, body string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", "x") for i, t in rows], SHAPE)


def brute(rows, run=D.RUN, least=D.MIN_CHARS, words=D.MIN_WORDS):
    """Every run of every document, in order; what comes second is repeated, and long stretches of it go."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t}, key=lambda x: x[0])
    seen, out = set(), {}
    for i, text in docs:
        parts = re.findall(D._PIECE, text)
        said = [(k, p.strip(D._BLANK).lower()) for k, p in enumerate(parts) if p.strip(D._BLANK)]
        repeated = [False] * len(said)
        for k in range(len(said) - run + 1):
            keys = tuple(s for _, s in said[k : k + run])
            if sum(map(len, keys)) >= least:
                if keys in seen:
                    repeated[k : k + run] = [True] * run
                seen.add(keys)
        gone, lost, k = set(), 0, 0
        while k < len(said):
            to = k
            while to < len(said) and repeated[to]:
                to += 1
            if to > k and sum(len(s.split(" ")) for _, s in said[k:to]) >= words:
                gone |= set(range(said[k][0], said[to - 1][0] + 1))
                lost += to - k
            k = max(to, k + 1)
        if gone:
            out[i] = (len(said), lost, "".join(p for k, p in enumerate(parts) if k not in gone))
    return out


def test_spans_match_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join("".join(rng.choices("abcdef", k=5)) for _ in range(rng.randint(1, 9))).capitalize() + rng.choice(".!?") for _ in range(60)]
    rows = []
    for i in range(80):
        said = rng.choices(pool, k=rng.randint(0, 25))
        if i % 3 == 0:
            said[2:2] = pool[10:16]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(said)))
    found = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in D.repeated_sentences(table(spark, rows)).collect()}
    assert found == brute(rows) and found


def test_span_edges(spark):
    passage = "First sentence of a long passage that holds words enough here. Second sentence goes on for a while. Third one ends it."
    long = "Filler %d is here. "
    rows = [(1, passage), (2, f"Own start. {passage} Own end."), (2, f"Own start. {passage} Own end."), (None, passage), (3, None), (4, ""), (5, "A. B. C. A. B. C."), (6, "".join(long % k for k in range(20_000)) + passage), (7, passage.upper())]
    found = {r.doc_id: r for r in D.repeated_sentences(table(spark, rows)).collect()}
    assert set(found) == {2, 6, 7}
    assert found[2].text == "Own start. Own end."
    assert found[7].text == "" and found[7].n_removed == 3 and found[6].n_sentences == 20_003 and found[6].text.endswith("Filler 19999 is here.")
    assert D.repeated_sentences(table(spark, rows)).columns == ["doc_id", "n_sentences", "n_removed", "text"]
    assert D.repeated_sentences(table(spark, [])).count() == 0


def test_two_shared_sentences_go_and_menus_stay(spark):
    rng = random.Random(8)
    one, two = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n)) + "." for n in (26, 27))
    menu = "Frequently asked questions\nSubscribe now\nPrivacy policy\n"
    rows = [(1, f"Start of the first. {one} {two} End of it."), (2, f"Another one begins {one} {two} and it goes on."), (3, f"{menu}Text of three."), (4, f"{menu}Text of four."), (5, f"Words {one} {two} x. {one} {two}")]
    found = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in D.repeated_sentences(table(spark, rows)).collect()}
    assert found == brute(rows) and set(found) == {5}  # in 2 the first sentence runs on from its own words
    rows[1] = (2, f"Another one begins. {one} {two} And it goes on.")
    found = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in D.repeated_sentences(table(spark, rows)).collect()}
    assert found == brute(rows) and set(found) == {2, 5}


def test_rows_that_share_an_id(spark):
    passage = "One sentence that is long enough to count here. And another that follows it and has some more words to say. "
    rows = [(1, passage + "A."), (1, passage + "B."), (2, passage), (2, passage)]
    found = [(r.doc_id, r.n_removed) for r in D.repeated_sentences(table(spark, rows)).collect()]
    assert sorted(found) == [(1, 2), (2, 2)]


@pytest.mark.parametrize("run, sql, name", [(D.op2_substring_dedup, D.OP2_SQL, "documents"), (W.op5_resolve_revisits, W.OP5_SQL, "pages")])
def test_sql(spark, sf_dir, run, sql, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    found = run(spark, sf_dir)
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize("url, key", [
    ("HTTP://WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#top", "example.com/a/b?a=1&b=2"), ("https://m.example.com/index.html", "example.com"), ("example.com/Path", "example.com/Path"), ("", ""), (None, None),
])
def test_canonical_url(spark, url, key):
    row = spark.createDataFrame([(url,)], "u string")
    assert row.select(W.canonical_url(row["u"])).first()[0] == key


RECORD = "record_id bigint, url string, ts timestamp, kind string, status int, headers map<string,string>, digest string, payload string, outcome string, base int"
T0 = datetime(2024, 1, 1)


def records(spark, rows):
    """(id, url, hour, kind, headers, digest, payload)."""
    full = [(i, u, None if h is None else T0 + timedelta(hours=h), k, 200 if k == "response" else 304, hs, d, p, "clash", 1) for i, u, h, k, hs, d, p in rows]
    return spark.createDataFrame(full, RECORD)


def test_revisits(spark):
    rows = [
        (1, "http://a.com/x", 0, "response", {"ETag": '"1"', "Content-Type": "t", "Date": "d0"}, "D1", "old"),
        (2, "https://www.a.com/x/", 2, "response", {"etag": '"2"', "Server": "s"}, "D2", "new"),
        (3, "http://a.com/x#f", 1, "revisit", {"ETag": 'W/"1"', "DATE": "d1", "Server": "no", "Content-Type": "no"}, None, None),
        (4, "http://a.com/x", 3, "revisit", {"ETag": '"1"'}, None, None), (5, "http://a.com/x", 2, "revisit", {"ETag": '"1"', "Last-Modified": "zz"}, "D2", None),
        (6, "http://a.com/x", 4, "revisit", {}, "D2", None), (7, "http://a.com/x", 4, "revisit", None, None, None), (8, "http://b.com", 4, "revisit", {}, "D2", None),
        (9, None, 4, "revisit", {}, "D2", None), (10, "http://a.com/x", None, "revisit", {}, "D2", None), (11, "http://a.com/x", 4, "revisit", {"Last-Modified": "q"}, "D2", None),
        (6, "http://a.com/x", 4, "revisit", {}, "D2", None), (12, None, None, "response", {}, "D", "p"), (13, "http://a.com/x", 9, "request", {}, None, None),
    ]
    found = W.resolve_revisits(records(spark, rows))
    assert found.columns == ["record_id", "url_key", "ts", "outcome", "response_id", "status", "headers", "payload"]
    got = {r.record_id: r for r in found.collect()}
    assert {k: (r.outcome, r.response_id, r.payload) for k, r in got.items()} == {
        3: ("resolved", 1, "old"), 4: ("mismatch", None, None), 5: ("resolved", 1, "old"), 6: ("resolved", 2, "new"), 7: ("unchecked", None, None), 8: ("missing", None, None), 9: ("missing", None, None),
        10: ("missing", None, None), 11: ("mismatch", None, None),
    }
    assert got[3].headers == 'content-type: t\ndate: d1\netag: W/"1"' and got[3].status == 200
    assert found.where("record_id = 6").count() == 2


def brute_revisits(rows):
    out = {}
    for i, u, h, k, hs, d, _ in rows:
        if k != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and r[1] == u and r[2] < h]
        base = max(before, key=lambda r: (r[2], r[0]), default=None)
        tag = hs.get("ETag")
        out[i] = ("missing", None) if base is None else ("resolved", base[0]) if tag == base[4].get("ETag") else ("mismatch", None)
    return out


def test_as_of_matches_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, f"h{rng.randint(0, 9)}.com", rng.randint(0, 30), rng.choice(["response", "revisit"]), {"ETag": rng.choice("ab")}, None, str(i)) for i in range(400)]
    found = {r.record_id: (r.outcome, r.response_id) for r in W.resolve_revisits(records(spark, rows)).collect()}
    assert found == brute_revisits(rows)


def test_no_records(spark):
    assert W.resolve_revisits(records(spark, [])).count() == 0
    same = [(1, "a.com", 0, "response", {}, "D", "b"), (1, "a.com", 0, "response", {}, "D", "a"), (2, "a.com", 1, "revisit", {}, "D", None)]
    assert [r.payload for r in W.resolve_revisits(records(spark, same)).collect()] == ["a"]


def test_header_names_that_differ_by_case(spark):
    shape = "record_id bigint, url string, ts timestamp, kind string, status int, entries array<struct<k:string,v:string>>, digest string, payload string"
    at = datetime(2024, 1, 1)
    rows = [
        (1, "http://a.org/", at, "response", 200, [("Server", "one"), ("ETag", "x"), ("SERVER", "two")], "d", "body" * 100_000),
        (2, "http://a.org/", at + timedelta(hours=1), "revisit", 304, [("Etag", "y"), ("etag", "x"), ("DATE", "now")], None, None),
    ]
    records = spark.createDataFrame(rows, shape).selectExpr("*", "map_from_entries(entries) as headers").drop("entries")
    found = W.resolve_revisits(records).collect()
    assert [(r.outcome, r.headers, len(r.payload or "")) for r in found] == [("resolved", "date: now\netag: x\nserver: two", 400_000)]
