"""The registered queries against brute force, and inputs that once broke an operator."""

import hashlib
import random
import sys
import time
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from strandframe.llm import decontaminate, media, mixing, neardup, pii, quality, repeats, toxicity, warc  # noqa: E402
from strandframe.llm import textvec as tv  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def morse(n):
    """Two different words of n letters that polynomial hashes modulo 2**64 confuse."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_structured_words_differ(spark):
    import pyarrow as pa

    for n in (8, 64, 128, 1024, 4096):
        a, b = morse(n)
        w = tv.words(*tv.utf8(pa.array([f"{a} {b} {a}"])), second=True)
        assert w.hash[0] != w.hash[1] and w.hash[0] == w.hash[2] and w.hash2[0] != w.hash2[1] and w.hash2[0] == w.hash2[2]
    a, b = morse(1024)
    line = [f"w{k}" for k in range(24)]
    rows = [(1, " ".join([*line[:12], a, *line[12:]])), (2, " ".join([*line[:12], b, *line[12:]])), (3, a), (4, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df, with_text=False).collect()} == brute.repeats(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 4).collect()} == brute.near_duplicates(rows)
    items = spark.createDataFrame([("x", a)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.find_contamination(df, items).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_repeats_query(spark, docs):
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.query(spark, SF).collect()} == brute.repeats(docs)


def test_pii_query(spark, docs):
    got = {r.doc_id: r for r in pii.query(spark, SF).collect()}
    for d, text in docs:
        want, r = brute.personal(text), got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in want) for k in ("email", "ip", "card", "phone")]
        spans = [f"{k}:{s}:{e}" for s, _, k, e in want]
        assert r.base_sha256 == brute.sha(",".join(spans))
        assert [x for x in (r.spans or "").split(",") if x and not x.startswith("iban")] == spans


def test_near_duplicates_query_and_recall(spark, docs):
    got = {r.doc_id: r for r in neardup.query(spark, SF).collect()}
    want = brute.near_duplicates(docs)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (n, c, c == d) for d, (n, c) in want.items()}
    # recall of bands alone: every row whose id is divisible by 100 against all rows, pairs at 0.8 or more
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {d: brute.shingles(t, 4) for d, t in rows}
    keys = {r.doc_id: set(r["keys"]) for r in neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 4).select("doc_id", "keys").collect()}
    near = [(a, b) for a in sets if a % 100 == 0 for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert near and sum(bool(keys[a] & keys[b]) for a, b in near) >= 0.99 * len(near)


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, b), (2, a), (3, b), (4, c), (4, c), (None, a), (5, None)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4)
    got = sorted((r.doc_id, r.component_id) for r in out.collect() if r.doc_id is not None)
    assert out.count() == len(rows) and got == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5)]
    assert [r.component_id for r in out.where("doc_id is null").collect()] == [None]


def test_near_duplicates_without_a_middle(spark):
    """Copies in a ring: each resembles its neighbours only, and lone texts share bands with many but are linked with none."""
    rng = random.Random(6)
    base = [f"v{k}" for k in range(300)]
    rows = []
    for k in range(40):
        own = list(base)
        for p in range(7 * k, 7 * k + 14):
            own[p % 300] = f"r{p}"
        rows.append((k, " ".join(own)))
    for k in range(60):
        own = list(base)
        for p in rng.sample(range(0, 300, 6), 11 + k % 6):
            own[p] = f"n{k}x{p}"
        rows.append((100 + k, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4).collect()}
    assert got == brute.near_duplicates(rows)


def test_decontamination_query(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.query(spark, SF).collect()}
    assert got == brute.contamination(docs, items)


def test_media_query(spark, docs):
    got = {r.doc_id: r for r in media.query(spark, SF).collect()}
    for d, text in docs:
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert got[d].media_bytes % media.PACKET == 0 and got[d].feature.endswith("errors=0")


def test_streams_with_faults_are_reported():
    stream = media.mux(bytes(range(256)) * 20)
    packet = lambda k: stream[k * media.PACKET : (k + 1) * media.PACKET]
    whole = [packet(k) for k in range(len(stream) // media.PACKET)]
    payload, facts = media.demux(stream)
    assert facts["continuity_errors"] == 0 and facts["programs"] == {1: [(media.STREAM_TYPE, media.DATA_PID)]}
    assert media.demux(b"".join([*whole[:5], whole[4], *whole[5:]]))[0] == payload  # one copy of a packet
    idle = bytearray(whole[4])
    idle[3], idle[4] = 0x20 | idle[3] & 15, media.PACKET - 5
    assert media.demux(b"".join([*whole[:5], bytes(idle), *whole[5:]]))[0] == payload  # no payload, same counter
    _, lost = media.demux(b"".join([*whole[:5], *whole[6:]]), strict=False)
    assert (lost["continuity_errors"], lost["cut"]) == (1, 1)
    twice = whole[0][:3] + bytes([0x15]) + whole[0][4:]
    assert media.demux(b"".join([whole[0], twice, *whole[1:]]), strict=False)[1]["continuity_errors"] == 1  # on the PID of the tables


def test_long_digit_runs_and_whole_context_words():
    began = time.time()
    assert [x[:3] for x in pii.find_spans("1" * 2_000_000 + " 10.0.0.1")] == [(2_000_001, 2_000_009, "ip")]
    assert time.time() - began < 5
    score = lambda text: next(x[3] for x in pii.find_spans(text) if x[2] == "ip")
    plain = score("10.0.0.1")
    assert score("gossip " + "x" * 36 + " 10.0.0.1") == plain and score("ipsum 10.0.0.1") == plain
    assert score("my ip is 10.0.0.1") > plain and score("10.0.0.1 is the server") > plain
    assert score("server " + "x " * 30 + "10.0.0.1") == plain


def test_wordless_texts_anywhere(spark):
    net = toxicity.WordNet()
    alone = float(net.raw(toxicity.tokens([""]))[0])
    for texts in (["", "a b c"], ["a b c", ""], ["a", "", "b"], [""], ["...", "!!", "?"], ["a b", "..."]):
        got = net.raw(toxicity.tokens(texts))
        assert all(abs(p - alone) < 1e-6 for p, t in zip(got, texts, strict=True) if not any(ch.isalnum() for ch in t))
    net.fit(["bad word", "", "fine day", "..."] * 20, np.array([1.0, 0, 0, 0] * 20, np.float32), ["en", None, "en", "fr"] * 20, steps=20)
    assert net.languages == ["en", "fr"] and len(net.cuts) == 3
    df = spark.createDataFrame([(1, "bad word"), (2, None), (3, "")], "doc_id long, text string").coalesce(1)
    assert toxicity.with_score(df, net).count() == 3


def test_null_page_ids(spark, tmp_path):
    page = "<p>" + "x" * 1200
    pages = spark.createDataFrame([(1, "u", page), (None, "u", page), (2, None, page), (None, "v", "short"), (3, "w", None)], "page_id long, url string, html string")
    index = warc.write_archives(pages, str(tmp_path / "n"))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.read_archives(index, str(tmp_path / "n")).collect())
    assert got == [(0, "response", 0), (0, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (3, "response", 0)]


def test_mixing_query_meets_targets_with_nonnegative_rates(spark):
    rows = mixing.query(spark, SF).collect()
    assert min(r.rate for r in rows) >= 0 and rows[0].target_gap < 1e-3
    k = len(rows[0].posterior)
    mass = np.array([np.array(r.posterior) * r.n_tokens for r in rows])
    got = (np.array([[r.rate] for r in rows]) * mass).sum(0)
    assert np.allclose(got / got.sum(), 1 / k, atol=2e-3)


def test_clashing_names_go_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).withColumnsRenamed({"source": "rate"}).selectExpr("*", "1 as copies", "2 as _score", "3 as rate_before")
    out = mixing.stage(spark, docs, SF)
    assert out.count() == 20 and {"rate", "rate_before_before", "copies_before", "_score", "rate_before"} <= set(out.columns)
    assert quality.stage(spark, docs, SF).columns == docs.columns


def test_repeats_of_hot_phrases_and_small_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(repeats, "SHARD", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df, with_text=False).collect()} == brute.repeats(docs)
