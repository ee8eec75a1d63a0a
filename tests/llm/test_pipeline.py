"""The stages of the pipeline on null ids, repeated ids, repeated rows and an empty table."""

import random
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


def test_near_dedup_keeps_one_row_of_every_group(spark):
    import corpus_pipeline as P

    a, b, c, d, e = (prose(k) for k in range(5))
    near = a + " " + prose(9, 2)
    rows = [(7, a, "s"), (7, a, "s"), (7, near, "s"), (3, near, "t"), (None, a, "s"), (None, b, "s"), (None, c, "s"), (8, d, "s"), (8, e, "s"), (9, "", "s"), (10, None, "s")]
    got = Counter((r.doc_id, r.text) for r in P.near_dedup(spark, table(spark, rows), "").collect())
    assert got == Counter([(3, near), (None, b), (None, c), (8, d), (8, e), (9, ""), (10, None)])
    assert P.near_dedup(spark, table(spark, rows).limit(0), "").count() == 0


def test_mix_takes_rows_as_often_as_the_operator_says(spark):
    import corpus_pipeline as P
    from tidemark.llm.mixing import mix_sources

    rows = [(i, prose(i, 5 + i % 30), f"s{i % 3}") for i in range(120)] + [(None, prose(1000 + i), "s0") for i in range(5)] + [(500, prose(2000 + i), "s1") for i in range(5)] + [(501, prose(3000), "s0")] * 4
    df = table(spark, rows)
    want = Counter()
    for r in mix_sources(df).collect():
        want[(r.doc_id, r.source)] += r.epochs + r.picked
    got = Counter((r.doc_id, r.source) for r in P.mix(spark, df, "").collect())
    assert got == +want and got[(None, "s0")] and got[(500, "s1")] and got[(501, "s0")]
    assert P.mix(spark, df.limit(0), "").count() == 0


def corpus_rows():
    """Some 200 documents: prose, copies, near copies, junk, toxic ones, null and repeated ids, empty and long texts."""
    rng = random.Random(40)
    stops = "the of and to in a is that it was for on are as with by".split()
    say = lambda n: " ".join(rng.choice(stops) if rng.random() < 0.4 else f"w{rng.randint(0, 500)}" for _ in range(n)).capitalize() + "."
    rows, toxic = [], {}
    for i in range(140):
        t = say(rng.randint(30, 90))
        toxic[i] = int(i % 7 == 0)
        rows.append((i, t + " you grumblewort" * toxic[i], f"s{i % 3}"))
    for i in range(20):  # near copies of the first
        words = rows[1][1].split()
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((200 + i, " ".join(words), "s1"))
    rows += [(300 + i, rows[2][1], "s2") for i in range(6)]
    rows += [(400 + i, " ".join(w + "###" for w in say(40).split()), "s0") for i in range(8)] + [(420 + i, "echo " * 60, "s0") for i in range(6)]
    rows += [(None, say(40), "s1"), (None, say(40), None), (None, None, "s1"), (500, "", "s0"), (501, say(4000), "s2"), (3, say(50), "s0"), rows[4], rows[4]]
    return rows, toxic


def components(rows):
    """The least (null last, id, text) of every near-duplicate group, by comparing all pairs."""
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return groups


def test_the_whole_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    from tidemark.llm.mixing import mix_sources
    from tidemark.llm.packing import _encoder

    rows, toxic = corpus_rows()
    docs = table(spark, rows)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, y in toxic.items()], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    outs = []
    for name, run in P.STAGES:
        stage = P.written(run(spark, stage, str(tmp_path)), "test")
        outs.append(stage.collect())
        if name != "packing":
            assert stage.columns == P.COLUMNS
    good, clean, kept, mixed, packed = outs
    held = Counter((r.doc_id, r.text) for r in good)
    assert not any(400 <= (i or 0) < 430 for i, _ in held) and sum(held[(i, t)] > 0 for i, t, _ in rows[:140]) >= 138 and (None, None) not in held
    assert Counter((r.doc_id, r.text) for r in clean) <= held
    wrong = [r for r in clean if "grumblewort" in (r.text or "")]
    assert len(wrong) <= 1 and sum("grumblewort" not in (r.text or "") for r in clean) == sum("grumblewort" not in (r.text or "") for r in good)
    groups = components([(r.doc_id, r.text, r.source) for r in clean])
    chosen = Counter((r.doc_id, r.text) for r in kept)
    assert sum(chosen.values()) == len(groups) and max(chosen.values()) == 1
    for members in groups.values():
        ids = [i for i, _, _ in members]
        least = min((i is None, i or 0) for i in ids)
        assert sum(chosen[(i, t)] for i, t in {(i, t) for i, t, _ in members}) == 1
        assert any(chosen[(i, t)] for i, t, _ in members if (i is None, i or 0) == least)
    times = Counter()
    for r in mix_sources(table(spark, [(r.doc_id, r.text, r.source) for r in kept])).collect():
        times[(r.doc_id, r.source)] += r.epochs + r.picked
    assert Counter((r.doc_id, r.source) for r in mixed) == +times
    encode = _encoder("byte_bpe_50k.json")
    want = Counter((r.doc_id, len(encode([r.text or ""])[0]) + 1) for r in mixed)
    got = Counter()
    by_sequence = {}
    whole = Counter()
    for p in packed:
        whole[p.doc_id] += p.length
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for (i, n), c in want.items():
        got[i] += n * c
    assert whole == got and all(sorted(v)[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:])) and sum(x[1] for x in v) <= 1024 for v in by_sequence.values())
    again = P.run(spark, str(tmp_path)).collect()
    facts = lambda ps: Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in ps)
    assert facts(again) == facts(packed)


def test_every_stage_on_odd_rows_and_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None, None, None), (1, "", "s"), (2, "a " * 200_000, "s"), (2, "a b c", None), (2, "a b c", None)]
    df = table(spark, rows)
    for name, run in P.STAGES:
        out = run(spark, df.selectExpr("*", "1 as SCORE", "2 as kept"), str(tmp_path))
        assert out.count() <= 400 and (name == "packing" or out.columns == P.COLUMNS)
        assert run(spark, df.limit(0), str(tmp_path)).count() == 0
