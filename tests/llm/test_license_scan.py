import random
import re

import pytest
from pyspark.sql import functions as F

from quartzite.llm import license_scan as ls

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text):
    """Base places by looking at every word; templates word by word along every offset."""
    w = words(text)
    places = [(i, label) for phrase, label in ls.BASE.items() for p in [phrase.split(" ")] for i in range(len(w)) if w[i : i + len(p)] == p]
    labels, score = {label for _, label in places}, 0.0
    for phrase, label in [*ls.BASE.items(), *ls.NOTICES.items()]:
        t = phrase.split(" ")
        k = min(ls.GRAM, len(t))
        covered = {}
        for d in range(-len(t), len(w)):
            met = {j for i in range(len(t) - k + 1) if d + i >= 0 and w[d + i : d + i + k] == t[i : i + k] for j in range(i, i + k)}
            if met:
                covered[d] = met
        for d, own in covered.items():
            near = {e: m for e, m in covered.items() if abs(e - d) <= ls.BAND} if len(t) >= ls.LONG else {d: own}
            if all((len(m), -e) <= (len(own), -d) for e, m in near.items()):
                share = len(set().union(*near.values())) / len(t)
                score = max(score, share)
                if share >= (ls.SHARE if len(t) >= ls.LONG else 1):
                    labels.add(label)
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(score, 9)


def scanned(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"label": F.lit("x"), "copy": F.lit(1), "size": F.lit(2)})
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in ls.license_scan(df).collect()), key=str)


def test_against_every_word_and_offset(spark):
    rng = random.Random(3)
    notices = [*ls.BASE, *ls.NOTICES]
    rows = [(1, None), (2, ""), (3, "MIT License"), (3, "MIT License"), (3, "other"), (None, "the APACHE-license"), (4, "mit license " * 300), (5, "mit licenses permit license"), (6, "General\nPublic\tLicense, v3; Éditions mit licensé")]
    rows += [(7, "word " * 200_000 + "apache license"), (8, "permission is hereby granted " * 40)]
    for i in range(120):
        text = []
        for _ in range(rng.randint(1, 4)):
            text += [rng.choice(["on", "the", "mit", "license", "of", "ünï"]) for _ in range(rng.randint(0, 12))]
            notice = rng.choice(notices).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(max(1, len(notice)))
                notice[at : at + 1] = rng.choice([[], ["xx"], [*notice[at : at + 1], "yy"]])
            text += notice
        rows.append((100 + i, rng.choice([" ", ", ", "\n"]).join(text)))
    want = sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert scanned(spark, rows) == want
    assert any("mit" in r[6].split(",") and "mit" not in r[5] for r in want)  # the notice without the name


def test_notices_with_words_put_in_and_taken_out(spark):
    text = next(k for k, v in ls.NOTICES.items() if v == "bsd" and len(k) > 50).split(" ")
    changed = ["Copyright", *text[:6], "and", "also", *text[6:12], *text[13:]]
    got = {r.doc_id: r for r in ls.license_scan(spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(text[:10])), (3, "redistribution of goods in use")], SCHEMA)).collect()}
    assert got[1].labels == "bsd" and got[1].score > 0.8 and got[2].labels == "" and 0 < got[2].score < 0.75 and got[3].score == 0
    (span,) = [r for r in ls.license_spans(spark.createDataFrame([(1, " ".join(changed))], SCHEMA)).where("found").collect()]
    assert (span.start, span.end) == (1, len(changed))


def test_no_documents_and_templates_that_are_too_short(spark):
    assert ls.license_scan(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        ls.templates({"mit": "mit"}, {})
