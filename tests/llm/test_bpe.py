import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quartzite.llm.bpe import SpeculativeBpe, encode_decode
from quartzite.llm.library_tokens import LibraryEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    return SpeculativeBpe(PATH), Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(1)
    pool = [chr(i) for i in [*range(1, 0x500), *range(0x1E00, 0x2080), *range(0x3041, 0x3097), 0x1F600, 0xFB01]]
    yield from ("".join(rng.choices("aeinorst", k=rng.randint(1, 14))) for _ in range(2000))
    yield from ("".join(rng.choices("ab", k=rng.randint(1, 40))) for _ in range(500))
    yield from ("".join(rng.choices("-=.*!'", k=rng.randint(1, 70))) for _ in range(500))
    yield from ("".join(rng.choices(pool, k=25)) for _ in range(1500))
    yield from ("a" * n for n in range(1, 130, 7))
    yield from ("", " ", "x <|endoftext|>Y<|startoftext|>", "ΑΣ Σ", "İstanbul", "don't WE'LL 123 ½", "a\x1cb\x85c　d")


def test_same_ids_and_text_as_the_library(pair):
    ours, library = pair
    xs = [*texts()]
    for x, (ids, shown), e in zip(xs, ours.encode_texts(xs), library.encode_batch(xs, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, x
        assert shown == library.decode(e.ids, skip_special_tokens=False) == ours.decode(e.ids)


def test_code_points_that_this_python_has_not_assigned(pair):
    import unicodedata

    ours, library = pair
    cn = [chr(i) for i in range(0x30000) if unicodedata.category(chr(i)) == "Cn"] + [chr(0xE0FFF), chr(0x10FFFF), chr(0x1FFFE)]
    xs = [f"acb 1{c}." for c in cn] + ["".join(cn[k : k + 40]) + "É " for k in range(0, 8000, 40)]
    known = LibraryEncoder(PATH)
    for x, (ids, _), other, e in zip(xs, ours.encode_texts(xs), known.encode_texts(xs), library.encode_batch(xs, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids == np.frombuffer(other, known.kind).tolist(), ascii(x)


def test_check_agrees_with_exact_merges(pair):
    ours, _ = pair
    words = [w.encode() for w in {"".join(random.Random(k).choices("thaneorisl", k=k % 15 + 1)) for k in range(3000)}]
    assert ours.encode_words(words) == [ours.merged(w) for w in words]


def test_library_words_are_the_librarys_ids():
    enc, library = LibraryEncoder(PATH), Tokenizer.from_file(PATH)
    xs = ["Hello, world!  It's 42.", "", "<|endoftext|> naïve", None]
    got = [np.frombuffer(b, enc.kind).tolist() for b in enc.encode_texts(xs)]
    assert got == [library.encode(x or "", add_special_tokens=False).ids for x in xs]


def test_frame_with_nulls_long_texts_and_clashing_columns(spark):
    long = "abc def " * 40_000
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, long, 5)], "doc_id long, text string, n_tokens int")
    rows = encode_decode(df, PATH).collect()
    assert len(rows) == 5
    by = {r.doc_id: r for r in rows}
    none = hashlib.sha256(b"").hexdigest()
    assert by[2].n_tokens == by[3].n_tokens == 0 and by[2].ids_sha256 == by[2].decoded_sha256 == none
    assert by[1].decoded_sha256 == hashlib.sha256(b"a</w> b</w>").hexdigest()
    assert by[None].n_tokens == 2 * 40_000 or by[None].n_tokens > 80_000
    assert encode_decode(df.limit(0), PATH).count() == 0
    shown = encode_decode(df.where("doc_id = 1"), PATH, arrays=True).first()
    assert shown.decoded == "a</w> b</w>" and len(shown.ids) == 2
