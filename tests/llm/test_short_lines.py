import corpus_pipeline


def test_stage_takes_short_repeats(spark, tmp_path):
    rows = [(1, "Les.\nWh the.\nfirst of all lines"), (2, "own words here\nLes.\n \nWh  the."), (3, "Les."), (4, "les.\n\n"), (None, "Wh the.\nleft")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, docs, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("own words here\n ", 16), 4: ("les.\n\n", 6), None: ("left", 4)}
