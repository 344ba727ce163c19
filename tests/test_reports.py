"""Phrase matching, name repair, samples and grids against DuckDB, and their defined cases."""

from airwave.operators import reports, texts
from airwave.plans import catalog

NAMES = ["term_match_join", "collapse_variants", "correct_names", "reaction_samples", "programme_segments", "headline_fallback", "blend_grid", "fit_blend_alpha", "cross_domain_eval"]


def test_reports_against_duckdb(spark):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("events", "documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    sql, queries, wrong = catalog.oracle_sql(), catalog.queries(), []
    for name in NAMES:
        df = queries[name](spark, sf)
        r = con.execute(sql[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns), name
        tidy = lambda x: round(float(x), 5) if isinstance(x, float) else x
        got = sorted(repr([tidy(row[c]) for c in sorted(names)]) for row in df.collect())
        want = sorted(repr([tidy(dict(zip(names, row))[c]) for c in sorted(names)]) for row in r.fetchall())
        if got != want or not got:
            wrong.append((name, len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]))
    assert not wrong, wrong


def test_longest_phrase_wins(spark):
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate("in the end of".split())] + [(2, 0, None)], "doc_id long, pos long, token string")
    phrases = spark.createDataFrame([("in",), ("in the",), ("in the end",), ("the",), ("the",)], "term string")
    assert sorted(map(tuple, reports.phrase_matches(tokens, phrases).collect())) == [(1, 0, "in the end", 3), (1, 1, "the", 1)]
    assert reports.phrase_matches(tokens.limit(0), phrases).count() == 0


def test_headline_says_something(spark):
    rows = [(1, " ", "s", ["a"], "t"), (2, None, None, list("abcde"), "t"), (3, "", "", None, "0:01"), (4, "x" * 200, "s", [], "t")]
    d = spark.createDataFrame(rows, "id long, headline string, summary string, keywords array<string>, timecode string")
    assert {r["id"]: r["headline"] for r in reports.headline_fallback(d).collect()} == {1: "s", 2: "a b c d", 3: "0:01", 4: "x" * 120}


def test_corrections_of_wanted_names_alone(spark):
    names = spark.createDataFrame([("anna", 3), ("annazz", 1), ("annaq", 1), ("annazzz", 5)], "name string, support long")
    drop = spark.createDataFrame([("zz",), ("q",), ("zzz",)], "term string")
    told = lambda rows: sorted(map(tuple, rows.collect()))
    assert told(reports.correct_names(names, drop)) == [("annaq", "anna"), ("annazz", "anna")]
    assert told(reports.correct_names(names, drop, wanted=names.where("name <> 'annaq'"))) == [("annazz", "anna")]


def test_names_are_found_once_and_persons_alone(spark):
    """What finds the people does not run again for each step that reads their names."""
    g = texts.Gazetteers(titles=["mr"], not_person=["viewer"], name_stop=["said"], organisations=["uni"], places=["in"], known_places=["rome"], patterns=texts.PATTERNS)
    docs = spark.createDataFrame([(1, "Mr Annabel Moor said 3 % in rome mr viewer uni mr mr 7"), (2, "mr annasaid"), (3, None)], "doc_id long, text string")
    told = lambda rows: sorted((r["doc_id"], r["text"], r["label"]) for r in rows.collect())
    people = texts.entities(docs, g.people())
    assert told(people) == told(texts.entities(docs, g).where("label = 'PERSON'")) and people.count() == 2
    names = spark.range(3).selectExpr("id AS doc_id", "'mr anna' || repeat('z', CAST(id AS INT)) AS text", "'PERSON' AS label")
    fixed = texts.repair_segment_names(names, spark.createDataFrame([("anna", 9)], "name string, support long"), spark.createDataFrame([("zz",)], "term string"), ["mr"])
    assert "Range" not in fixed._jdf.queryExecution().optimizedPlan().toString()
    assert told(fixed) == [(0, "mr anna", "PERSON"), (1, "mr annaz", "PERSON"), (2, "mr anna", "PERSON")]
