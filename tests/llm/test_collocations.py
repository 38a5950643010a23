import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from quantloom.llm import collocations as co


def plain(rows, least, longest, keep):
    """Every phrase of every piece, counted one by one."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for j in range(i + 1, min(i + longest, len(w)) + 1):
                    f[lang][tuple(w[i:j])] += 1
    out = []
    for lang, counts in f.items():
        good = []
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in cand.items():
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in cand.items())
            if not inside:
                good.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(good)[:keep])]
    return sorted(out)


def test_equals_counting_every_phrase(spark, monkeypatch):
    monkeypatch.setattr(co, "GROUP", 4)  # pivots in several groups
    monkeypatch.setattr(co, "PACK", 2)
    rng = random.Random(7)
    words = ["a", "B", "b", "é", "the", "The", "\x00", "x y", "zz", "Ä", "1"]
    rows = [(None, None), ("de", ""), ("fr", " \t .;"), (None, "a b a b a b a b")]
    for _ in range(300):
        text = "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["de", "de", "en", None]), text))
    rows += [("en", "one two three")] * 50 + [("hot", "u v u v w. u v w")] * 200
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "1 as phrase", "2 as key", "3 as n")
    for least, longest, keep in ((3, 4, 2000), (5, 3, 7), (2, 2, 50), (3, 6, 40)):
        found = co.collocations(df, least, longest, keep).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, found.collect())) == plain(rows, least, longest, keep)


def test_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(empty).collect() == []
    assert co.collocations(spark.createDataFrame([(None, None)], "lang string, text string"), 1).collect() == []


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(co, "CHUNK", 16)
    texts = ["a b. " * 20, "", "x" * 100 + " y,z", "ab"]
    b = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(texts)], ["lang", "text"])
    pieces = []
    for _, data, at in co._chunks(b):
        assert len(data) <= 32 or b"x" * 100 in data.tobytes()
        data, offsets, new = co.tokens(data, at)
        for i in range(len(offsets) - 1):
            word = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            pieces.append([word]) if new[i] else pieces[-1].append(word)
    assert pieces == [["a", "b"]] * 20 + [["x" * 100, "y"], ["z"], ["ab"]]
