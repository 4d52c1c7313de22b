import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quartzite.llm import token_counts as C
from quartzite.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")


def docs(spark):
    rows = [(i, f"word{i} and some more {'x' * (i % 50)} text" * (i % 7), 1, 2) for i in range(300)] + [(300, None, 1, 2), (301, "", 1, 2), (302, 'a " b ". c', 1, 2), (302, "again", 1, 2), (303, "long text " * 30_000, 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, n_tokens int").repartition(5)


def test_files_come_back_in_order(spark):
    manifest = T.write_token_files(docs(spark), PATH, length=64)
    got = T.read_token_files(manifest).orderBy("start").collect()
    library, at = Tokenizer.from_file(PATH), 0
    wanted = sorted(docs(spark).collect(), key=lambda r: (r.doc_id, r.text or ""))
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted, strict=True):
        ids = np.array([*library.encode(w.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (w.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_sequences_have_one_length_and_padding_only_at_the_end(spark):
    for row in T.write_token_files(docs(spark), PATH, length=32).collect():
        masks = np.concatenate([m for _, m, _ in T.sequences(row.path)])
        assert masks.shape[1] == 32 and masks.sum() == row.n_tokens
        flat = masks.ravel()
        assert flat[: row.n_tokens].all() and not flat[row.n_tokens :].any()
        assert sum(e.sum() for _, _, e in T.sequences(row.path)) == row.n_docs


def test_no_documents(spark):
    manifest = T.write_token_files(docs(spark).limit(0), PATH)
    assert manifest.count() == 0 and T.read_token_files(manifest).count() == 0
    assert C.token_counts(docs(spark).limit(0), PATH).count() == 0


def test_counts_by_separators_alone(spark):
    library = Tokenizer.from_file(PATH)
    got = sorted((r.doc_id, r.n_tokens) for r in C.token_counts(docs(spark), PATH).collect())
    assert got == sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs(spark).collect())


def flat_counts(path, end):
    """Documents of a flat file, one id after the other."""
    ids = np.fromfile(path.removeprefix("file://"), "<u2").tolist()
    out, size = [], 0
    for i in ids:
        if i == end:
            out.append(size)
            size = 0
        else:
            size += 1
    return out


def test_documents_over_many_blocks(spark):
    files, _, end = C.write_flat_files(docs(spark).select("doc_id", "text"), PATH)
    plain = {(r.path, k): n for r in files.collect() for k, n in enumerate(flat_counts(r.path, end))}
    assert len(plain) == 305
    for block in (C.BLOCK, 1000, 7):
        assert {(r.path, r.number): r.n_tokens for r in C.scan_counts(files, end, block=block).collect()} == plain
    small, _, _ = C.write_flat_files(docs(spark).where("doc_id between 290 and 302").select("doc_id", "text").coalesce(1), PATH)
    plain = {(r.path, k): n for r in small.collect() for k, n in enumerate(flat_counts(r.path, end))}
    for block in (1, 2, 3):
        assert {(r.path, r.number): r.n_tokens for r in C.scan_counts(small, end, block=block).collect()} == plain


def test_random_access_to_sequences_copies_nothing(spark, monkeypatch):
    import pyarrow as pa

    from quartzite.llm.library_tokens import library_encoder

    enc, folder = library_encoder(PATH), None
    rng = np.random.default_rng(1)
    for n_docs in (0, 3, 400):
        sink = pa.BufferOutputStream()
        monkeypatch.setattr(T, "BATCH", 8)
        out, flat = T.SequenceWriter(sink, enc.kind, 16), []
        for _ in range(n_docs):
            ids = rng.integers(2, 1000, rng.integers(0, 60)).astype(enc.kind)
            flat += [*ids.tolist(), 1]
            out.add(np.append(ids, 1).astype(enc.kind))
        out.close()
        import tempfile

        with tempfile.NamedTemporaryFile(suffix=".arrows") as folder:
            folder.write(sink.getvalue())
            folder.flush()
            file = T.SequenceFile(f"file://{folder.name}")
            assert len(file) == -(-len(flat) // 16)
            before = pa.total_allocated_bytes()
            for k in rng.permutation(len(file)).tolist():
                ids, mask, ends = file.sequence(k)
                own = flat[16 * k : 16 * k + 16]
                assert not ids.flags.owndata and not ids.flags.writeable and pa.total_allocated_bytes() == before
                assert ids[: len(own)].tolist() == own and mask.to_pylist() == [j < len(own) for j in range(16)]
                assert [j for j, e in enumerate(ends.to_pylist()) if e] == [j for j, i in enumerate(own) if i == 1]
                del ids, mask, ends
            file.close()


def test_ids_of_other_types(spark):
    df = docs(spark).where("doc_id < 40").selectExpr("concat('d', lpad(doc_id, 3, '0')) as doc_id", "text")
    got = [r.doc_id for r in T.read_token_files(T.write_token_files(df, PATH)).orderBy("start").collect()]
    assert got == [f"d{i:03d}" for i in range(40)]
