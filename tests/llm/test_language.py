import random

from quartzite.llm import language as L

WORDS = {"en": "the of and that this with for you from house water time".split(), "de": "der die und nicht für mit über schön straße wasser zeit".split(), "fr": "le la et que pour avec était être maison eau temps".split()}


def labelled(spark, n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice([*WORDS])
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(4, 60))), lang if i % 17 else None, lang, 0.5))
    rows += [(n, None, "en", "en", 0.5), (n + 1, "", "en", "en", 0.5), (n + 2, "123 !!", "en", "en", 0.5), (n + 3, "the house " * 20_000, None, "en", 0.5), (None, "der wasser und", "de", "de", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, score double")


def test_held_out_accuracy_and_undetermined(spark):
    df = labelled(spark)
    rows = L.identify(df, sample=300, landmarks=60).collect()
    assert len(rows) == 405
    ok = [r.lang_pred == r.truth for r in rows if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert len(ok) > 60 and sum(ok) / len(ok) > 0.97
    by = {r.doc_id: r for r in rows}
    assert [by[400 + k].lang_pred for k in range(4)] == ["und", "und", "und", "en"] and by[400].score == 0
    assert all(0 <= r.score <= 1 for r in rows) and by[None].lang_pred == "de" and by[None].held_out is False


def test_held_out_rows_teach_nothing(spark):
    df = labelled(spark)
    other = df.withColumn("lang", L.F.when(L.held_out(), L.F.lit("xx")).otherwise(L.F.col("lang")))
    assert L.identify(other, sample=300, landmarks=60).where("lang_pred = 'xx'").count() == 0


def test_nothing_to_learn_and_no_rows(spark):
    df = labelled(spark)
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", L.F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identify(df.limit(0)).count() == 0


def test_letters_of_all_planes(spark):
    df = labelled(spark).select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(900, "\U00020000\U00020001 \U00020002"), (901, "\U0001f600 12"), (902, "\U00031350")], "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) as lang")
    by = {r.doc_id: r.lang_pred for r in L.identify(df.unionByName(rare), sample=300, landmarks=60).where("doc_id >= 900").collect()}
    assert by[901] == "und" and by[900] != "und" and by[902] != "und"


def test_against_a_plain_kernel_machine():
    """The same landmarks and ridge with sets in place of matrices: kernel values, features and scores one by one."""
    import numpy as np

    rng, alphabet = random.Random(3), "abcdefgh"
    words = {"x": ["ab", "abc", "cab", "bad"], "y": ["fe", "feg", "hef", "gab"], "z": ["dada", "hd", "ch", "ea"]}
    texts = [(lang, " ".join(rng.choices(words[lang], k=rng.randint(2, 9)))) for lang in words for _ in range(12)]

    def grams(t):
        c = "".join(x if x in alphabet else " " for x in t.lower())
        return {c[k : k + n] for n in (1, 2, 3) for k in range(len(c) - n + 1) if c[k : k + n].strip()}

    machine, codes = L.Grams(alphabet), []
    for _, t in texts:
        flags = np.zeros(machine.width, bool)
        machine.fill(t, flags)
        codes.append(np.flatnonzero(flags))
        assert len(codes[-1]) == len(grams(t))
    labels = [lang for lang, _ in texts]
    model = L.LanguageModel(alphabet, codes, labels, 9, L.RIDGE)
    order = sorted(range(len(texts)), key=L.hash_of)
    marks = [[i for i in order if labels[i] == lang][k] for k in range(3) for lang in sorted(words)]
    alike = lambda s, t: len(grams(s) & grams(t)) / (len(grams(s)) * len(grams(t))) ** 0.5
    kernel = np.array([[alike(texts[i][1], texts[j][1]) for j in marks] for i in marks])
    value, vector = np.linalg.eigh(kernel)
    root = vector[:, value > 1e-6 * value[-1]] / np.sqrt(value[value > 1e-6 * value[-1]])
    features = lambda t: np.array([alike(t, texts[j][1]) for j in marks]) @ root
    left = np.array([features(t) for _, t in texts]) / 12**0.5
    right = np.array([[lang == x for x in sorted(words)] for lang, _ in texts]) / 12**0.5
    solved = np.linalg.solve(left.T @ left + L.RIDGE * np.eye(left.shape[1]), left.T @ right)
    new = [" ".join(rng.choices(words[lang], k=4)) for lang in words for _ in range(5)]
    langs, scores = model.predict([*new, None, "", "12"], machine)
    assert langs[-3:] == ["und"] * 3
    for t, lang, score in zip(new, langs, scores, strict=False):
        plain = features(t) @ solved
        assert lang == sorted(words)[plain.argmax()] and abs(score - min(1, max(0, plain.max()))) < 1e-3


def test_presence_kernel_counts_distinct_grams():
    import numpy as np

    grams = L.Grams("ab")
    flags = np.zeros(grams.width, bool)
    assert grams.fill("abab", flags)
    assert flags.sum() == 2 + 2 + 2  # a, b; ab, ba; aba, bab
    assert not grams.fill("12", np.zeros(grams.width, bool))


def test_languages_of_many_scripts(spark):
    """Six scripts and one with thousands of letters: none is told by the letters of another."""
    rng = random.Random(8)
    ranges = {"en": (97, 26), "el": (0x3B1, 17), "ru": (0x430, 32), "hi": (0x915, 35), "ka": (0x10D0, 33), "th": (0xE01, 46), "zh": (0x4E00, 3000)}
    stems = {lang: ["".join(chr(a + rng.randrange(n)) for _ in range(rng.randint(2, 5))) for _ in range(60)] for lang, (a, n) in ranges.items()}
    rows = [(i, " ".join(rng.choices(stems[lang], k=rng.randint(5, 40))), lang) for i, lang in enumerate(lang for lang in ranges for _ in range(150))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.lang, r.lang_pred) for r in L.identify(df).where("held_out").collect()]
    for lang in ranges:
        own = [b == a for a, b in got if a == lang]
        assert len(own) > 20 and sum(own) / len(own) >= 0.95, lang


def test_codes_are_those_of_plain_sets():
    rng = random.Random(9)
    grams = L.Grams("".join(chr(0x4E00 + i) for i in range(400)))
    for text in ("".join(chr(0x4E00 + rng.randrange(500)) if rng.random() < 0.9 else " " for _ in range(3000)), "ab一", "一", " "):
        c = [grams.classes[ord(x)] for x in text]
        n, plain = grams.size, set()
        for k in (1, 2, 3):
            for i in range(len(c) - k + 1):
                if any(c[i : i + k]):
                    plain.add(sum(int(x) * n ** (k - 1 - j) for j, x in enumerate(c[i : i + k])) + (n if k > 1 else 0) + (n * n if k > 2 else 0))
        assert grams.codes(text).tolist() == sorted(plain)
