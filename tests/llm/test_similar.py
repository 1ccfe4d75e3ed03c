import random

import corpus_pipeline
from shardloom.llm import simhash, similar


def plain_set(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similarity(a, b):
    x, y = plain_set(a), plain_set(b)
    return len(x & y) / len(x | y)


def test_stage_drops_near_copies(spark, tmp_path):
    """Copies of 0.8 or more go, those below stay; two bits of 64 leave most of them."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows, near, far = [], [], []
    for g in range(150):
        base = r.choices(words, k=r.randrange(100, 400))
        rows.append((g, " ".join(base)))
        copy = list(base)
        for k in range(max(1, len(base) // (60 if g % 2 else 20))):
            copy[r.randrange(len(copy))] = f"other{k}"
        i = 1000 + g
        rows.append((i, " ".join(copy)))
        (near if plain_similarity(" ".join(base), " ".join(copy)) >= 0.8 else far).append(i)
    assert len(near) > 50 and len(far) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    kept = {x.doc_id for x in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert set(range(150)) | set(far) <= kept  # nothing goes for less
    assert sum(i not in kept for i in near) / len(near) >= 0.97
    thin = {x.doc_id for x in simhash.keep_one(docs).collect()}
    assert sum(i not in thin for i in near) / len(near) < 0.5


def test_odd_rows(documents, rows, nothing):
    kept = similar.keep_one(documents)
    assert kept.columns == documents.columns
    got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    # Every kept text is unlike the others, and every row has a like one that is kept or is one itself.
    sets = [plain_set(t) for _, t in got]
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    assert not any(alike(x, y) for k, x in enumerate(sets) for y in sets[:k])
    assert all(any(alike(plain_set(t), y) for y in sets) for _, t in rows)
    assert similar.keep_one(nothing).count() == 0


def test_every_row_of_a_crowded_family_finds_its_group(spark, tmp_path):
    """Hundreds of texts that share most but not enough, some with close copies: no limit on candidates hides a link."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for g in range(60):  # within the radius of each other, but under 0.8
        text = list(base)
        for k in range(4):
            text[(g * 7 + k * 50) % 200] = f"own{g}_{k}"
        rows.append((g, " ".join(text)))
        for c in range(3):
            copy = list(text)
            copy[(g * 11 + c * 31) % 200] = f"c{c}"
            rows.append((1000 + 10 * g + c, " ".join(copy)))
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    sets = {i: plain_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted({find(i) for i in sets})
    plenty, few = (sorted(x.doc_id for x in similar.keep_one(docs, **options).collect()) for options in ({}, {"nearest": 1, "split": 5}))
    assert plenty == few  # rounds go on until nothing was left out
    assert set(want) <= set(plenty) and len(plenty) <= len(want) + 3  # pairs that share no anchor


def test_repeated_rows_and_other_splits(spark, tmp_path):
    """One of equal rows stays, and numbers don't depend on how the source is cut."""
    rows = [(i % 40, f"text number {i % 40} " + " ".join(f"x{i % 40}_{k}" for k in range(30))) for i in range(200)] + [(None, "alone a b c d e f")] * 2
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(f"{tmp_path}/t")
    kept = similar.keep_one(spark.read.parquet(f"{tmp_path}/t"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = sorted((str(x.doc_id), x.text) for x in kept.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted({(str(i), t) for i, t in rows})


def test_rows_grow_with_the_texts_and_not_with_their_pairs(spark, tmp_path, monkeypatch):
    """A large family of texts that are all within the radius and mostly apart: no table lists its pairs."""
    r = random.Random(21)
    base, rows = [f"w{i}" for i in range(200)], []
    for g in range(300):
        text = list(base)
        for k in range(4):
            text[(g * 7 + k * 50 + r.randrange(9)) % 200] = f"own{g}_{k}"
        rows.append((g, " ".join(text)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    counts, settle = {}, similar.settle

    def counted(df, tag):
        out = settle(df, tag)
        counts[tag] = max(counts.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(similar, "settle", counted)
    kept = similar.keep_one(spark.read.parquet(f"{tmp_path}/t")).count()
    assert kept > 30 and max(counts.values()) <= len(rows), counts
