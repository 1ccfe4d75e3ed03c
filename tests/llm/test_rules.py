import re
from collections import Counter, defaultdict

import numpy as np

from shardloom.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    again = {k + i for k, w in enumerate(windows) if often[w] > 1 for i in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_counts_and_verdicts(documents, rows, nothing):
    got = rules.op4(documents).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *counts(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules.op4(nothing).count() == 0


def test_thresholds_follow_the_source(spark):
    plain = [(i, f"w{i} these are quite ordinary words of text number {i} with nothing odd in them at all", "en", "a") for i in range(300)]
    noisy = [(1000 + i, f"x{i} " + " ".join(f"word{j}#$" for j in range(20)), "en", "b") for i in range(300)]
    stray = [(5000, "y " + " ".join(f"word{j}#$%" for j in range(20)), "en", "a")]
    got = {r.doc_id: r.kept for r in rules.op4(spark.createDataFrame(plain + noisy + stray, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and all(got[1000 + i] for i in range(300)) and not got[5000]


def test_quantiles_of_merged_sketches(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.lognormal(0, 2, 3000), "b": np.concatenate([np.zeros(500), rng.random(1500)])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "g string, v double")
    at = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    own = {r.g: r for r in rules.quantiles(rules.sketch(df, ["g"], "v"), ["g"], at).collect()}
    every = rules.quantiles(rules.merge(rules.sketch(df, ["g"], "v").withColumn("all", df.g.isNotNull()), ["all"]), ["all"], at).first()
    exact = defaultdict(list, {k: sorted(v) for k, v in groups.items()})
    for values, found in [*((exact[k], own[k]) for k in own), (sorted(exact["a"] + exact["b"]), every)]:
        for name, q in at.items():
            true = values[int(np.ceil(q * len(values))) - 1]
            assert abs(found[name] - true) <= 0.008 * true + 1e-12


def test_each_rate_rejects_by_itself(spark):
    plain = [(i, "\n".join(f"w{i}x{j} these{j} are quite ordinary words" for j in range(20)), "en", "a") for i in range(300)]
    clean = plain[0][1]
    ordinary = [f"v{j} these{j} are quite ordinary words" for j in range(20)]
    stray = {
        "symbol_rate": clean.replace("quite", "qui#e", 12),
        "mean_word": clean.replace("ordinary", "extraordinarily"),
        "mean_word below": clean.replace("ordinary", "o").replace("quite", "q"),
        "dup_line_rate": "\n".join([*ordinary[:11], *(["ordinary"] * 4), *(["quite"] * 6)]),  # 8 of 21 lines
        "repeat_rate": "\n".join([*ordinary[:10], "a once said thing again and a once said thing again"]),
    }
    for name, text in stray.items():
        n, chars, symbols, dup, again, lines = rules.text_counts(text)
        assert 100 * again <= 20 * n, name  # the base rule keeps each
    odd = [(1000 + k, text, "en", "a") for k, text in enumerate(stray.values())]
    got = {r.doc_id: r for r in rules.op4(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(300))
    assert not any(got[i].base_failed for i, *_ in odd)
    assert {name: got[1000 + k].kept for k, name in enumerate(stray)} == dict.fromkeys(stray, False)


def test_fences_follow_each_group_and_any_join_gives_the_same(spark):
    rows = [(i, " ".join(f"w{i}x{j}{'y' * (i % 3)}" for j in range(20 + 40 * (i % 4) + i % 7)), "en", f"s{i % 4}") for i in range(400)] + [(900, None, None, None), (900, None, None, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    fences = rules.thresholds(rules.count_table(documents)).collect()
    assert len({r.fences[name]["high"] for r in fences for name in ("repeat_rate",)}) == 4
    assert len({r.fences["mean_word"]["low"] for r in fences}) > 1
    few, many = (sorted(map(str, rules.apply_rules(documents, most).select("doc_id", "n_words", "kept").collect())) for most in (rules.BROADCAST, 0))
    assert few == many and len(few) == 402
