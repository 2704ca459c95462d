"""The corpus operators against brute force, and their edge cases.

The edge fixture has nulls, empty and blank texts, a long one, ties, repeated
rows and extra columns whose names the operators use inside.
"""

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from strandframe.llm import chat, decontaminate, labelled, media, mixing, neardup, pii, quality, repeats, toxicity, warc  # noqa: E402
from strandframe.llm import textvec as tv  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, start long, key string, score double, component string"
RNG = random.Random(8)
WORDS = [f"w{k}" for k in range(300)]
PROSE = [" ".join(RNG.choice(WORDS) for _ in range(90)) for _ in range(6)]
EDITED = PROSE[0].split()
EDITED[40] = "changed"
TEXTS = {
    1: None, 2: "", 3: " \t\n ", 4: "one", 5: "One two  three", 6: PROSE[0], 7: PROSE[0].upper(), 8: " ".join(EDITED), 9: PROSE[1] + " " + PROSE[2],
    10: PROSE[3] + "\n" + PROSE[2], 11: "du " * 70 + "ende", 12: "du " * 45, 13: PROSE[0], 14: "é à ü " * 12, 15: " ".join(RNG.choice(WORDS) for _ in range(40_000)), 16: "one", 17: "x" * 300_000, 18: "a b c d\x1ce",
}


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(k, t, 1, "k", 0.5, "c") for k, t in TEXTS.items()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_words_and_hashes():
    buf, offsets = tv.utf8(__import__("pyarrow").array([*TEXTS.values()]))
    for piece in (7, 1 << 20):
        old, tv.PIECE_BYTES = tv.PIECE_BYTES, piece
        if piece == 7:
            cut = int(offsets[14])
            w = tv.words(buf[:cut], offsets[:15])
        else:
            w = tv.words(buf, offsets)
        tv.PIECE_BYTES = old
        texts = [*TEXTS.values()][: len(w.first) - 1]
        assert w.counts.tolist() == [len(brute.SPACED.findall(t or "")) for t in texts]
        seen = {}
        for t, a in zip(texts, w.first, strict=False):
            for k, word in enumerate(brute.SPACED.findall(t or "")):
                assert seen.setdefault(word, w.hash[a + k]) == w.hash[a + k]
        assert len(set(seen.values())) == len(seen)


def test_repeats(spark, edge, nothing):
    got = by_id(repeats.remove_repeats(edge, with_text=False), "n_words", "n_removed", "kept_sha256")
    assert got == brute.repeats([*TEXTS.items()])
    assert got[13][1] == 90 and got[6][1] == 0
    again = repeats.remove_repeats(edge.union(edge.where("doc_id in (1, 6, 13)")), with_text=False)
    assert by_id(again, "n_removed")[13] == (90,) and again.where("doc_id = 6").count() == 2
    assert by_id(again, "n_removed")[6] == (0,)
    assert repeats.remove_repeats(nothing).count() == 0
    assert by_id(repeats.remove_repeats(edge.where("doc_id = 5")), "kept")[5] == ("One two three",)


def test_near_duplicates(spark, edge, nothing):
    got = by_id(neardup.near_duplicates(edge, 4), "n_shingles", "component_id")
    assert got == brute.near_duplicates([*TEXTS.items()])
    assert got[8] == (87, 6) and got[1] == (0, 1)
    again = neardup.near_duplicates(edge.union(edge.where("doc_id in (1, 6, 13)")), 4)
    assert again.count() == len(TEXTS) + 3 and by_id(again, "component_id")[13] == (6,)
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies that resemble a common base but hardly one another: links run through the base only."""
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(400)]
    rows = [(500, " ".join(base))]
    for k in range(120):
        own = list(base)
        for p in rng.sample(range(400), 12):
            own[p] = f"n{k}x{p}"
        rows.append((k, " ".join(own)))
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4), "n_shingles", "component_id")
    assert got == brute.near_duplicates(rows)


def test_estimates_follow_the_jaccard_index():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        n = 3000
        both = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.int64).astype(np.uint64)
        sets = neardup.Sets.__new__(neardup.Sets)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**63, n - len(both), dtype=np.int64).astype(np.uint64)))) for _ in range(2))
        sets.values, sets.rows = np.concatenate((a, b)) << np.uint64(1), np.repeat([0, 1], [len(a), len(b)])
        sets.first = np.array([0, len(a), len(a) + len(b)])
        reg, own = neardup.registers(sets)
        assert abs((reg[0] == reg[1]).mean() - share) < 0.12
        small = neardup.compressed(reg, own).view(np.uint8)
        unlike = sum(((small[0] >> k) & 15 != (small[1] >> k) & 15).sum() for k in (0, 4))
        assert abs(1 - unlike * 15 / 14 / own.any(0).sum() - share) < 0.15


def test_decontamination(spark, edge, nothing):
    items = [(1, " ".join(PROSE[2].split()[10:40])), (2, "ONE"), (3, None), (4, "..."), (10, "One-two three"), (11, " ".join(PROSE[2].split()[12:30])), (12, "zz zz")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = brute.contamination([*TEXTS.items()], items)
    for block in (1 << 20, 100):
        got = decontaminate.find_contamination(edge, bench, block_bytes=block)
        got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.n_hit > 0) for r in got.collect()}
        assert got == want
    assert want[9][2] == 2 and want[5][2] == 2
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    assert decontaminate.find_contamination(edge, bench.limit(0)).where("n_hit > 0").count() == 0
    cut = decontaminate.find_contamination(edge, bench, keep=edge.columns, cut=True)
    assert cut.columns == edge.columns
    left = by_id(cut, "text")
    assert 4 not in left and left[1] == (None,) and left[6] == (TEXTS[6],)
    assert decontaminate.find_contamination(cut.where("doc_id <> 5"), bench).where("n_hit > 0").count() == 0


def test_fm_index():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 6, 500)
    index = decontaminate.FMIndex(text)
    for n in (1, 2, 4):
        phrases = np.array([text[k : k + n] for k in range(0, 490, 7)] + [[7] * n, [5] * n])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [k for k in range(500 - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_personal_data(spark, nothing):
    texts = [
        None, "", "mail a.b@x.de, c@d@e.fr x@y", "ip 1.2.3.4 300.1.1.1 1.2.3.4.5 " + "9" * 5000 + ".1.1.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (30) 123456-78 +1 2 +12345678901234567",
        "IBAN DE89 3704 0044 0532 0130 00 or DE88370400440532013000", "üü 10.0.0.1 ä@b.c é@b.cd", "@@ a@ @b.c a@b.c@d.e", "5500005555555559" * 2, "x@a.b" * 500, "1 " * 30_000,
    ]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: [(x.start, x.kind, x.end) for x in r.found] for r in pii.detect(df).collect()}
    for k, t in enumerate(texts):
        assert [x for x in got[k] if x[1] in pii.BASE_KINDS] == [(s, kind, e) for s, _, kind, e in brute.personal(t)]
    assert [x[1] for x in got[6] if x[1] == "iban"] == ["iban"]
    assert pii.detect(nothing.select("doc_id", "text")).count() == 0
    assert pii.redact("a@b.c x", pii.find_spans("a@b.c x")) == "[EMAIL] x"
    scores = [x[3] for t in ("card 4111111111111111", "4111111111111111") for x in pii.find_spans(t)]
    assert scores[0] > scores[1]
    assert pii.redacted(df).columns == df.columns


def test_media_round_trip(edge, nothing):
    rng = random.Random(1)
    for size in (0, 1, 63, 64, 65, 176, 184, 5000, media.PES_BYTES, 2 * media.PES_BYTES + 1):
        raw = rng.randbytes(size)
        stream = media.mux(media.payload_of(raw))
        back, facts = media.demux(stream)
        assert back == raw.ljust(max(64, -(-size // 64) * 64), b"\0")
        assert facts["continuity_errors"] == 0 and len(facts["random_access"]) == len(facts["pts"])
        assert facts["pts"] == [k * media.TICKS for k in range(len(facts["pts"]))]
    broken = bytearray(media.mux(bytes(5000)))
    del broken[5 * media.PACKET : 6 * media.PACKET]
    with pytest.raises(media.StreamError):
        media.demux(bytes(broken))
    got = {r.doc_id: r for r in media.store(edge).join(media.stored_and_read(edge).drop('n_bytes'), 'doc_id').collect()}
    for k, t in TEXTS.items():
        raw = media.payload_of((t or "").encode())
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
    assert got[6].feature == got[13].feature and got[6].media_sha256 == got[13].media_sha256
    assert media.stored_and_read(nothing).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long_ = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a", long_, 0), (2, None, long_, 0), (3, "u\r\nx", "short", 0), (4, "u", "short", 0), (5, "u", None, 0), (6, "u", "", 0), (7, "u", "z" * 600_000, 0), (9, "u", long_, 0), (9, "u", long_, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size long")
    index = warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(index, str(tmp_path / "w")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id < 4 or r.page_id == 9) == [(1, "revisit", 9), (2, "revisit", 9), (3, "response", None), (9, "response", None), (9, "response", None)]
    for r in got:
        raw = (next(h for i, _, h, _ in rows if i == r.page_id) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert r.payload == (raw if r.record_type == "response" else b"")
    name = next((tmp_path / "w").glob("*.zst"))
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(name.open("rb"), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n")
    empty = warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(empty, str(tmp_path / "e")).count() == 0


def test_chat_template_is_reversible(spark):
    texts = ["", None, chat.PROBE, "\\", "\\|", "<|", "<\\|", "a\\\\|b<|im_end|>\n", "<|im_start|>user\n", "\n", "𝄞<|"]
    rows = [(k, i, role, t) for k, t in enumerate(texts) for i, role in enumerate(("user", "assistant", "odd\nrole <|", None))]
    df = spark.createDataFrame([*rows, (50, None, "assistant", "x"), (50, 1, "user", "y"), (50, 1, "user", "y"), (None, 1, "user", "n")], "conv_id long, turn long, role string, text string")
    records = chat.gather(df)
    turns = records.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns, "conv_id"), "conv_id").collect()}
    for k, t in enumerate(texts):
        assert [(x.role, x.text) for x in got[k].turns] == [("user", t or ""), ("assistant", t or ""), ("odd\nrole <|", t or ""), ("", t or "")]
        assert got[k].loss_texts == [t or ""]
    assert [x.text for x in got[50].turns] == ["x", "y", "y"] and got[None].loss_texts == []
    assert chat.gather(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    shape = "id long, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, instruction string, input string, output string, system string, prompt string, completion string, qa struct<question:string,answer:string>"
    rows = [
        (1, [("user", "a"), ("assistant", "b")], None, None, None, None, None, None, None, None), (2, None, [("human", "a"), ("gpt", "b")], None, None, None, None, None, None, None), (3, None, None, "do", "x", "y", None, None, None, None),
        (4, None, None, "do", None, "y", "sys", None, None, None), (5, None, None, None, None, None, None, "p", "c", None), (6, None, None, None, None, None, None, None, None, ("q", "r")), (7, None, None, None, None, None, None, "p", None, None), (8, *[None] * 9),
    ]
    got = {r.id: r for r in chat.to_turns(spark.createDataFrame(rows, shape), "id").collect()}
    told = {k: r.turns and [(t.role, t.text) for t in r.turns] for k, r in got.items()}
    assert told == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "a"), ("assistant", "b")], 3: [("user", "do\n\nx"), ("assistant", "y")], 4: [("system", "sys"), ("user", "do"), ("assistant", "y")], 5: [("user", "p"), ("assistant", "c")], 6: [("user", "q"), ("assistant", "r")], 7: None, 8: None}
    assert got[7].mapping == "unknown" and got[1].fingerprint == chat.fingerprint_of(["messages[].role", "messages[].content"])


def _accuracy(df, labels, column):
    j = df.join(labels, "doc_id").where("held_out")
    return j.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]


def test_classifiers(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = quality.query(spark, sf).cache()
    assert q.count() == 1000 and _accuracy(q, labels, "quality") >= 0.9
    assert {r.doc_id: r.held_out for r in q.limit(50).collect()} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in q.limit(50).collect()}
    t = toxicity.query(spark, sf).cache()
    assert t.count() == 1000 and _accuracy(t, labels, "toxic") >= 0.85
    assert t.where("score < 0 or score > 1 or score is null").count() == 0


def test_classifiers_on_edges(spark, edge, nothing):
    few = spark.createDataFrame([(6, 1, 0), (7, 0, 1), (8, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        label = {"quality": quality.ByteNet, "toxicity": toxicity.WordNet}[module.__name__.rsplit(".", 1)[1]]
        net = label().fit([b"good" if module is quality else "good", b"bad" if module is quality else "bad"] * 8, np.array([1.0, 0.0] * 8, np.float32), steps=5)
        got = by_id(module.with_score(edge, net), "score")
        assert set(got) == set(TEXTS) and all(0 <= s[0] <= 1 for s in got.values())
        assert abs(got[6][0] - got[13][0]) < 1e-5 and abs(got[1][0] - got[2][0]) < 1e-5
        assert module.with_score(nothing, net).count() == 0
        assert by_id(module.with_score(edge, label().fit([], np.zeros(0))), "score")[6] == (0.5,)
    got = labelled.sample(edge.drop("score"), few, "quality", 4, 9, 10)
    assert [r[0] for r in got] == [6, 7]
    assert [c for c in labelled.scored(edge.select("doc_id", "score"), 4, 2).columns] == ["doc_id", "held_out", "score", "predicted"]


def test_mixing(spark, edge, nothing):
    members = spark.createDataFrame([(k, 100 + k, [0.9, 0.1] if k % 3 else [0.2, 0.8]) for k in range(60)] + [(99, 0, [0.5, 0.5])], "doc_id long, n_tokens long, posterior array<double>")
    for floor, weights in ((0.0, [1.0, 3.0]), (1.0, [1.0, 1.0]), (0.0, [1.0, 0.0])):
        rate, report = mixing.fit_rates(members, weights, floor)
        rows = members.withColumn("r", rate).collect()
        assert min(r.r for r in rows) >= floor and rows[-1].r == 1.0
        assert [sum(r.r * r.n_tokens * r.posterior[j] for r in rows) for j in range(2)] == pytest.approx(report["expected"])
        # no better nonnegative rates: the gradient vanishes where a rate is free, and points inward at the floor
        gap = np.array(report["expected"]) - np.array(report["targets"])
        total = sum(report["targets"])
        for r in rows[:-1]:
            slope = float(np.dot(r.posterior, gap)) / total
            assert slope > -1e-3 and (r.r <= floor + 1e-6 or abs(slope) < 1e-3)
    labels = spark.createDataFrame([(6, 1), (9, 1), (14, 0)], "doc_id long, quality int")
    docs = edge.withColumn("lang", F.when(F.col("doc_id") == 14, "fr").otherwise("en"))
    out, report = mixing.mix(docs, labels, ["doc_id", "lang"], floor=1.0)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(TEXTS) and got[1].rate == 1.0 and all(r.copies >= 1 for r in got.values())
    assert report["domains"] == ["en", "fr"] and got[14].posterior[1] > 0.5
    empty, _ = mixing.mix(docs.limit(0), labels.limit(0), ["doc_id"])
    assert empty.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        from strandframe.session import materialize

        after = materialize(stage(spark, before, SF), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        if name == "MinHash near-dedup":
            want = brute.near_duplicates([(r.doc_id, r.text) for r in before.collect()], 5)
            assert {r.doc_id for r in after.collect()} == {k for k, (_, c) in want.items() if k == c}
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(v[1] for v in brute.contamination([(r.doc_id, r.text) for r in after.collect()], items).values())
        before = after
    assert before.where("copies < 1 or rate < 1").count() == 0
