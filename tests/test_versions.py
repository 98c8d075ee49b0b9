def test_versions_in_any_order_and_over_restarts(spark, tmp_path):
    """The state tells the newest version: late ones are dropped, and frequencies are those of the last versions, as often as the query starts again."""
    from conceptweave.streaming import versions

    docs = "doc_id long, text string, version long"
    batches = [
        [(1, "hund kat", 5), (2, "kat", 1), (3, "fugl", 1), (1, "gammel", 4), (None, "ingen", 1), (4, "uden nummer", None)],
        [(1, "for sent", 3), (2, "hund hund", 2), (2, "hund a", 2), (3, None, 7), (5, "", 1)],
        [(3, "endnu senere", 6), (1, "kat ny", 6), (2, "sent", 2)],
    ]
    last = {}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, docs).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(docs).parquet(f"{tmp_path}/in")
        versions.frequencies(source, f"{tmp_path}/df", f"{tmp_path}/ck").awaitTermination(120)
        best = {}
        for i, t, v in rows:
            if i is not None and v is not None and (i not in best or (v, t or "") > best[i]):
                best[i] = (v, t or "")
        for i, b in best.items():
            if i not in last or b[0] > last[i][0]:
                last[i] = b
        want = {"": len(last)}
        for _, t in last.values():
            for w in {w for w in t.split() if w != "a"}:
                want[w] = want.get(w, 0) + 1
        assert {r.word: r.df for r in versions.current(spark, f"{tmp_path}/df").collect()} == want, n
    assert {"for", "endnu", "gammel"}.isdisjoint(want) and want["ny"] == 1
