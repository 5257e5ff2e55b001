import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import line_dedup as D

LINE = "this line has quite enough words in it to be counted here"
ROWS = [
    (3, f"Top\n{LINE}\nend"),
    (1, f"{LINE.upper()}\nown text of the first document that nobody else has at all"),
    (2, f"a\n  {LINE.replace(' ', '   ')}  \n{LINE}"),
    (4, None),
    (5, ""),
    (6, "short\nshort"),
    (7, "short"),
    (None, LINE),
    (8, LINE),
    (8, LINE),
]


def brute(rows, min_words=1):
    """Row -> removed lines; the first occurrence by (null last, doc_id, row, place) stays."""
    first, out = {}, {i: [] for i in range(len(rows))}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        at = 0
        for line in (rows[i][1] or "").split("\n"):
            norm = " ".join(line.lower().split())
            if len(norm.split()) >= min_words:
                if norm in first:
                    out[i].append((at, at + len(line), first[norm]))
                else:
                    first[norm] = rows[i][0]
            at += len(line) + 1
    return sorted((str(rows[i][0]), str(v)) for i, v in out.items())


def found(df):
    return sorted((str(r["doc_id"]), str([(x["start"], x["end"], x["first_doc_id"]) for x in r["removed"]])) for r in df.collect())


@pytest.mark.parametrize("least", [1, 10])
def test_against_brute_force(docs, least):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 25))) for _ in range(40)]
    rows = ROWS + [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    table = docs(rows).coalesce(1).withColumn("digest", F.lit(1)).withColumn("removed", F.lit(2)).withColumn("rid", F.lit(3))
    assert found(D.dedup_units(table, min_words=least)) == brute(rows, least)


def test_text_left_and_clean_documents_alone(docs):
    got = {r["doc_id"]: r for r in D.dedup_units(docs(ROWS[:7]), min_words=10).collect()}
    assert set(got) == {r[0] for r in ROWS[:7]}
    assert got[3]["text"] == "Top\nend" and got[3]["first_doc_ids"] == [1]
    assert got[2]["text"] == "a\n" and got[2]["n_removed"] == 2
    for d, r in got.items():
        text = dict(ROWS[:7])[d]
        for x in r["removed"]:
            assert D.normalised(text[x["start"] : x["end"]]) == LINE
        if d not in (2, 3):
            assert (r["text"], r["n_removed"], r["n_passages"], r["removed_chars"], r["first_doc_ids"]) == (text, 0, 0, 0, [])


def test_paragraphs_and_empty_table(docs):
    a = "one two three four five\nsix seven eight nine ten"
    got = D.dedup_units(docs([(1, f"{a}\n\nx"), (2, f"y\n \n{a}")]), "paragraph").collect()
    assert {r["doc_id"]: r["removed_chars"] for r in got} == {1: 0, 2: len(a)}
    assert D.dedup_units(docs([])).count() == 0


def windows(text):
    """Ranges of the chosen windows, one window and one neighbourhood at a time."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\v\f\r]+", text)]
    low = [re.sub("[A-Z]+", lambda m: m[0].lower(), text[a:b]) for a, b in words]
    value = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in low]
    order = [(value[i] + 40503 * value[i + 1] + 30011 * value[i + 2]) % 4294967291 for i in range(len(words) - 25)]
    chosen = {j for i in range(len(order) - 24) for j in range(i, i + 25) if order[j] == min(order[i : i + 25])}
    return [(words[j][0], words[j + 25][1], " ".join(low[j : j + 26])) for j in sorted(chosen)]


def brute_all(rows):
    """Each line with words, each run of two or more such lines, and each chosen window: all but
    the first place goes; ranges that overlap are one."""
    found = {}
    for i in range(len(rows)):
        text, at, lines = rows[i][1] or "", 0, []
        for line in text.split("\n"):
            lines.append((at, at + len(line)))
            at += len(line) + 1
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                inner = [text[s:e].strip() for s, e in lines[a : b + 1]]
                edges = [text[s:e].strip() for s, e in [*lines[a - 1 : a], *lines[b + 1 : b + 2]]]
                if all(inner) and (a == b or not any(edges)):
                    found.setdefault(" ".join(text[lines[a][0] : lines[b][1]].lower().split()), []).append((i, lines[a][0], lines[b][1]))
        for start, end, norm in windows(text):
            found.setdefault(("window", norm), []).append((i, start, end))
    gone = {i: [] for i in range(len(rows))}
    for places in found.values():
        places.sort(key=lambda p: (rows[p[0]][0] is None, rows[p[0]][0] or 0, *p))
        for i, start, end in places[1:]:
            if i != places[0][0] or start >= places[0][2]:
                gone[i].append((start, end, rows[places[0][0]][0]))
    out = {}
    for i, spans in gone.items():
        out[i] = []
        for start, end, first in sorted(spans, key=lambda s: (s[0], -s[1], s[2] is None, s[2])):
            if out[i] and start < out[i][-1][1]:
                out[i][-1] = (out[i][-1][0], max(end, out[i][-1][1]), out[i][-1][2])
            else:
                out[i].append((start, end, first))
    return out


def listed(rows):
    return sorted((str(rows[i][0]), ",".join(":".join(str(v) for v in s if v is not None) for s in spans)) for i, spans in brute_all(rows).items())


def test_query_removes_short_lines_and_paragraphs_by_brute_force(spark, docs, folder):
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["", " \t", "one two\nthree four", "one\ntwo three four"]
    rows = ROWS[:-1] + [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    got = D.op7_line_dedup(spark, folder(documents=docs(rows).coalesce(1))).collect()
    assert sorted((str(r["doc_id"]), r["removed"]) for r in got) == listed(rows)


def test_query_catches_passages_within_lines_by_brute_force(spark, docs, folder):
    rng = random.Random(7)
    fresh = lambda n: [f"é{rng.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(n) for n in (51, 60, 90, 400)]
    rows = [(500, "one " * 200), (501, "one " * 90 + "two"), (502, "a b " * 70), (503, None), (504, "")]
    for i in range(60):
        parts = [x for k in range(3) for x in (fresh(rng.randint(0, 60)), rng.choice(shared) if rng.random() < 0.6 else [])]
        words = [rng.choice((str.upper, str))(w) if w.isascii() else w for p in parts for w in p]
        rows.append((i, "".join(w + rng.choice(("  ", "\n", " ", " ", " ")) for w in words)))
    got = D.op7_line_dedup(spark, folder(documents=docs(rows).coalesce(1))).collect()
    assert sorted((str(r["doc_id"]), r["removed"]) for r in got) == listed(rows)
    texts = dict(rows)
    kept = {r["doc_id"]: (r["text"] or "").split() for r in got}
    runs = lambda words, n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    for passage in shared:  # beyond its first copy at most 24 words at either end are left
        holders = [d for d, t in rows if t and tuple(passage) in runs(t.split(), len(passage))]
        assert len(holders) > 5
        inner = runs(passage[24 : len(passage) - 24], 3)
        assert [d for d in sorted(holders) if inner & runs(kept[d], 3)] == [min(holders)]
    assert {r["text"] for r in got if not r["n_removed"]} <= set(texts.values())


def test_query_catches_a_passage_in_short_lines_and_one_with_other_breaks(spark, docs, folder):
    words = [f"word{i}" for i in range(60)]
    four, nine = ("\n".join(" ".join(words[i : i + n]) for i in range(0, 60, n)) for n in (4, 9))
    got = D.op7_line_dedup(spark, folder(documents=docs([(1, f"x\n\n{four}\n\nx1"), (2, f"y\n{four}\ny1"), (3, f"z\n\n{nine}\n\nz1")]))).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: f"x\n\n{four}\n\nx1", 2: "y\ny1", 3: "z\n\n\nz1"}
