"""The toxicity model learns from every labelled row, not from a sample of them."""

from strandframe.llm import labelled, toxicity


def test_rows_beyond_the_start_train(spark):
    ids = [(k, k % 2) for k in range(900)]
    labels = spark.createDataFrame(ids, "doc_id long, toxic int")
    plain = spark.createDataFrame([(k, "") for k, _ in ids], "doc_id long, text string")
    first = {r[0] for r in labelled.sample(plain, labels, "toxic", toxicity.FOLDS, toxicity.HELD, 60)}
    rows = [(k, f"fine text w{k % 7} " + ("" if not y else "blurgh" if k in first else "zork"), "aa" if k in first else "bb") for k, y in ids]
    docs = spark.createDataFrame([*rows, (5000, "long " * 20_000 + "zork", "cc")], "doc_id long, text string, lang string")
    net = toxicity.train(docs, labels.union(spark.createDataFrame([(5000, 1)], labels.schema)), rows=60)
    assert net.languages == ["aa", "bb"]
    ask = spark.createDataFrame([(1, "fine text w1 zork"), (2, "fine text w1"), (3, "fine text w2")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.with_score(ask, net).collect()}
    assert got[1] >= labelled.CUT > max(got[2], got[3])


def test_passes_move_the_start(spark):
    table = spark.createDataFrame([(s, k, f"{'awful' if k % 2 else 'nice'} day", k % 2) for s in range(3) for k in range(40)], "shard int, doc_id long, text string, label int")
    table = table.repartition(2, "shard").sortWithinPartitions("shard", "doc_id")
    net = toxicity.WordNet()
    begin, memory = net.flat(), net.start([], None)
    toxicity._pass(table, net, memory, 0.5)
    want, moved = [], 0
    for _ in range(3):  # all shards are equal here, so the mean is what one of them does alone
        own = toxicity.WordNet()
        adam, seen = own.start([], None)
        for at in (0, 32):
            take = range(at, min(at + 32, 40))
            own._step(toxicity.tokens([f"{'awful' if k % 2 else 'nice'} day" for k in take]), toxicity.np.array([k % 2 for k in take], "f4"), adam, seen, 0.5)
        want.append(own.flat())
    moved = abs(net.flat() - begin).max()
    assert moved > 0.01 and abs(net.flat() - sum(want) / 3).max() < 1e-4
