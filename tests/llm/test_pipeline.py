import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from shardloom.llm import decontaminate, pii, quality
from shardloom.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    """The smallest id of every component of similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids, seen, kept = sorted(sets), set(), set()
    for i in ids:
        if i not in seen:
            kept.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [j for j in ids if j not in seen and len(sets[x] & sets[j]) >= 0.8 * len(sets[x] | sets[j])]
    return kept


@needs_tables
def test_run_is_its_stages(spark):
    """Each decision again: by plain shingles, plain search, the spans of operator 2, and the library's own ids."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = quality.fit_compression_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score_quality(docs, model).where("predicted = 1").collect()}
    kept = groups({i: texts[i] for i in good})
    words = lambda t: " ".join(w.decode() for w in decontaminate.words_of(t.encode()))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in kept if not any(t in words(texts[i]) for t in items)}
    assert {r.doc_id for r in got} == clean
    # Masked texts: every span of operator 2 (of the documents that reach the stage) replaced, from the end.
    left = docs.where(docs.doc_id.isin([int(i) for i in clean]))
    masked = {}
    for r in pii.op2(left).collect():
        text, end = texts[r.doc_id], 0
        spans = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in r.spans.split(",") if x))
        out = []
        for k, (a, b, kind) in enumerate(spans):
            if a >= end:
                last = max(-y for x, y, _ in spans[k:] if x < -b or x == a)
                out.append(text[end:a] + f"<{kind.upper()}>")
                end = last
        masked[r.doc_id] = "".join(out) + text[end:]
    library = Tokenizer.from_file(tokenizer_file())
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    filled = Counter()
    for i, rows in pieces.items():
        ids = np.array([*library.encode(masked[i], add_special_tokens=False).ids, 0], "<u4")
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(r.length for r in rows) == len(ids)
        for r in rows:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 1


@needs_tables
def test_every_stage_takes_odd_and_empty_rows(spark, documents, nothing):
    for docs in (documents, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            rows = out.count()
            assert rows <= docs.count() or name == "best_fit_packing"
            assert rows or docs is nothing, name


def test_masked_texts_hold_no_base_entity(spark, documents):
    for r in corpus_pipeline.personal_data(spark, documents, "").select("text").collect():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text or "")
