"""Ids, decoded texts and counts against the library, and token files against plain reading."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weftline.llm import arrow_files as A
from weftline.llm import bpe, counts, tokens

BYTE = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
WORD = Tokenizer.from_file(tokens.vocabulary_path("word_bpe_49k.json"))
ODD = [
    "", " ", "a", " a", "a ", "a  b", "a \n b c d", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c<|endoftext|><|endoftext|>", "it's 'tis don't 12 345 a1b2", "\u00a0a \u3000b c",
    "日本 語\t x", "a\x00b \x1c c d\x85e", " " * 50 + "b", "…a  b", "aaaaaaa aaaaaaaaaaaaaa hahahahahaha =======", "ééé ñandú", "It's 'tis DON'T we're I've he'll 'l 'r 'v 'x ''s !'s 'same 'really",
    "<|startoftext|>a<|endoftext|>", "ΑΣ Σ ΟΔΥΣΣΕΥΣ", "e\u0301 A\u030a İstanbul ǅ ﬁ", "'", " 'r", "½ ² Ⅷ", "a\u200db \u180e x", "w" * 5000, None,
]


def mixed(n):
    rng = random.Random(n)
    return ["".join(rng.choice("'''rRevlLstmdx 1!.\n\t é<|aA") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def split(ids, ends):
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@pytest.fixture(scope="module")
def texts(rows):
    return ODD + mixed(800) + [t for _, t in rows]


@pytest.fixture(scope="module")
def want(texts):
    return [x.ids for x in BYTE.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_library_over_pieces(texts, want):
    for _ in range(2):  # once anew, once known
        assert split(*tokens.encode(pa.array(texts), "byte_bpe_50k.json")) == want
    assert len(tokens.encode(pa.array([], pa.string()), "byte_bpe_50k.json")[0]) == 0


def test_known_pieces_are_bounded(texts, want, monkeypatch):
    monkeypatch.setattr(tokens.Known, "most", 50)
    monkeypatch.setattr(tokens, "_known", {})
    assert split(*tokens.encode(pa.array(texts), "byte_bpe_50k.json")) == want
    assert len(tokens._known["byte_bpe_50k.json"].words) <= 50


def test_pair_index(texts, want):
    ids, ends = bpe.encode(pa.array(texts))
    assert split(ids, ends) == want
    assert bpe.decode(ids, ends) == [BYTE.decode(x, skip_special_tokens=False) for x in want]


def test_decoding_broken_bytes():
    every = np.arange(50_257, dtype=np.uint32)
    assert bpe.decode(every, np.arange(1, len(every) + 1)) == [BYTE.decode([i], skip_special_tokens=False) for i in every.tolist()]


def test_merges_of_one_symbol():
    merges = bpe.load_merges("byte_bpe_50k.json")
    words = [c.encode() * n for c in "ah=- " for n in range(1, 40)]
    ids, lengths = bpe.merge_words(merges, words)
    assert all(b"".join(merges.spelled[i] for i in part) == w for part, w in zip(split(ids, np.cumsum(lengths)), words, strict=True))


def test_transducer_counts(texts):
    got = counts.count_tokens(pa.array(texts))
    assert got.tolist() == [len(x.ids) for x in WORD.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_chunks_do_not_matter(texts):
    joined = "\n".join(t or "" for t in texts)
    classes = counts.class_table()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    whole = counts.marks(classes, len(classes))
    for chunk in (1, 2, 7, 100):
        assert (counts.marks(classes, chunk) == whole).all()


def test_word_machine_bounds(texts, monkeypatch):
    monkeypatch.setattr(counts.WordMachine, "most_states", 500)
    monkeypatch.setattr(counts, "_machines", {})
    rng = random.Random(3)
    long = ["".join(rng.choices("aeinorst日é", k=5000)) for _ in range(3)]
    test_transducer_counts(texts + long)
    machine = counts._machines["word_bpe_49k.json"]
    test_transducer_counts(long)  # one word after another, each beyond the bound by one state at most
    assert len(machine.states) <= 501 + len(long)


def test_joints_are_those_that_merging_leaves():
    merges = bpe.load_merges("word_bpe_49k.json")
    joints = counts.Joints(merges)
    rng = random.Random(5)
    inner = [t for t in range(merges.size) if t in joints.left_over and not WORD.id_to_token(t).endswith("</w>")]
    last = [t for t in range(merges.size) if t in joints.left_over and WORD.id_to_token(t).endswith("</w>")]
    common = rng.choices(inner[:2000], k=4000) + rng.choices(inner, k=2000)
    pairs = [(a, b) for a, b in zip(common, rng.choices(last[:2000], k=3000) + rng.choices(last, k=3000), strict=True)]
    back = {c: b for b, c in enumerate(bpe.byte_letters())}
    words = [bytes(back[c] for c in (WORD.id_to_token(a) + WORD.id_to_token(b)).removesuffix("</w>")) for a, b in pairs]
    ids, lengths = bpe.merge_words(merges, words)
    merged = split(ids, np.cumsum(lengths))
    apart = [joints.first_across(a, b) is None for a, b in pairs]
    assert apart == [m == [a, b] for m, (a, b) in zip(merged, pairs, strict=True)] and len(set(apart)) == 2


def test_word_machine_needs_word_ends():
    with pytest.raises(ValueError):
        counts.WordMachine("byte_bpe_50k.json")


def test_places_emit_what_is_final():
    machine = counts.WordMachine("word_bpe_49k.json")
    words = ["the", "thethethe", "qzxj", "naïveté", "日本語", "=" * 70]
    got = machine.count(pa.array([w.encode() for w in words], pa.large_binary()))
    assert got.tolist() == [len(WORD.encode(w, add_special_tokens=False).ids) for w in words]
    assert (machine.emits >= 0).all()
    ended = machine.keys % 512 >= 256
    assert (machine.targets[ended] == 0).all() and (machine.emits[ended] > 0).all()


def test_units_are_bounded():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 5, 50, 1, 1, 1)] + [None]})
    sizes = [t["text"].to_pylist() for t in tokens.units([batch, batch.slice(0, 0), batch], most=10)]
    assert [x for s in sizes for x in s] == batch.column("text").to_pylist() * 2
    assert all(len(s) == 1 or sum(len(x or "") for x in s) <= 10 for s in sizes)


def test_tables(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = sorted((repr(i), BYTE.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    got = bpe.encode_documents(odd, decoded=True).collect()
    assert sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert sorted((repr(r.doc_id), r.text) for r in got) == sorted((repr(i), t or "") for i, t in rows)
    assert sorted(repr(r.text) for r in bpe.decode_documents(bpe.encode_documents(odd)).collect()) == sorted(repr(t or "") for _, t in rows)
    counted = sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in counts.count_documents(odd).collect())
    sizes = [(repr(i), len((t or "").encode()), len(WORD.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert counted == sorted((*s, s[2] > 2048) for s in sizes)
    for f in (bpe.encode_documents, counts.count_documents, A.store_documents):
        assert f(odd.limit(0)).count() == 0


def test_token_files(spark, odd, documents):
    for df in (documents, odd):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect()))
        got = {}
        for r in A.store_documents(df).collect():
            got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
        at, ids = 0, {}
        for there, i, t in rows:
            x = [*BYTE.encode(t, add_special_tokens=False).ids, 0]
            ids.setdefault(i if there else None, []).append((at, len(x), zlib.crc32(np.array(x, "<u4"))))
            at += len(x)
        assert {k: sorted(v) for k, v in got.items()} == ids


def test_sequences_are_views(tmp_path):
    ids = np.arange(10_000, dtype=np.uint16)
    with open(tmp_path / "x.arrows", "wb") as sink:
        writer = A.SequenceWriter(sink, 64, pa.uint16(), 10)
        for k in range(0, len(ids), 777):
            writer.write(ids[k : k + 777])
        writer.close()
    file = A.SequenceFile(f"file://{tmp_path}/x.arrows")
    one, mask = file.sequence(100)
    assert (one == ids[6400:6464]).all() and not one.flags.owndata and all(mask.to_pylist())
    last, mask = file.sequence(156)
    assert mask.to_pylist() == [True] * 16 + [False] * 48 and (last[:16] == ids[-16:]).all()
    assert (file.span(600, 2000) == ids[600:2600]).all() and len(file.span(0, 0)) == 0
    assert pa.ipc.open_stream(str(tmp_path / "x.arrows")).schema.field("ids").type.list_size == 64


def test_one_sequence_reads_one_batch(tmp_path):
    """Through a file that only counts and passes on, as a remote one; and from a mapped file without allocation."""
    with open(tmp_path / "x.arrows", "wb") as sink:
        writer = A.SequenceWriter(sink, 64, pa.uint16(), 10)
        writer.write(np.arange(64 * 10 * 500 + 7, dtype=np.uint32).astype(np.uint16))
        writer.close()

    class Counting:
        def __init__(self):
            self.file, self.bytes, self.closed = open(tmp_path / "x.arrows", "rb"), 0, False

        def read(self, n=-1):
            got = self.file.read(n)
            self.bytes += len(got)
            return got

        def __getattr__(self, name):
            return getattr(self.file, name)

    counting = Counting()
    file = A.SequenceFile(pa.PythonFile(counting, mode="r"))
    opened = counting.bytes
    assert file.batches == 501 and opened < 2 * file.stride
    ids, mask = file.sequence(4321)
    assert (ids == np.arange(4321 * 64, 4322 * 64).astype(np.uint16)).all() and all(mask.to_pylist())
    assert counting.bytes - opened <= file.stride
    assert file.span(64 * 10 * 500 - 3, 10).tolist() == [x % 65536 for x in range(64 * 10 * 500 - 3, 64 * 10 * 500 + 7)]
    with pytest.raises(IndexError):
        file.sequence(5010)
    mapped = A.SequenceFile(f"file://{tmp_path}/x.arrows")
    before = pa.total_allocated_bytes()
    held = [mapped.sequence(k)[0] for k in range(0, 5000, 7)]
    assert pa.total_allocated_bytes() - before < 1 << 16 and held[3][0] == 21 * 64


def test_empty_sequence_file(tmp_path):
    with open(tmp_path / "x.arrows", "wb") as sink:
        A.SequenceWriter(sink, 64, pa.uint16(), 10).close()
    file = A.SequenceFile(f"file://{tmp_path}/x.arrows")
    assert file.batches == 0 and len(file.span(0, 0)) == 0


def test_files_are_bounded_and_failed_attempts_swept(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/out"
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "part-000000-000000-999999.arrows").write_bytes(b"what a lost attempt left")
    doubled = documents.select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    files = A.write_files(doubled, folder, partitions=2, most=1_000, unit=2_000)
    whole = A.write_files(doubled, f"file://{tmp_path}/other", partitions=1)
    assert sum(f["documents"] for f in files) == doubled.count() and len(files) > 5 and len(whole) == 1
    longest = max(len(t.encode()) for (t,) in documents.select("text").collect() if t)
    assert all(f["ids"] < 1_000 + 2_000 + longest for f in files)
    names = {f[k].rpartition("/")[2] for f in files for k in ("data", "index")}
    assert {p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")} == names
    read = A.read_files(spark, files).collect()
    again = A.read_files(spark, A.write_files(doubled, f"file://{tmp_path}/third", partitions=5)).collect()
    assert sorted(read) == sorted(again) and len(read) == doubled.count()
    last = max(read, key=lambda r: r.start)
    assert last.start + last.n_tokens == sum(f["ids"] for f in files)


def test_many_special_strings_take_linear_time():
    import time

    from weftline.llm.bpe import _parts

    special = {"<|endoftext|>": 0, "<|im_start|>": 1}
    text = "a<|endoftext|><|im_start|>" * 50_000 + "b"
    began = time.process_time()
    parts = list(_parts(text, special))
    assert time.process_time() - began < 1
    assert len(parts) == 150_001 and "".join(p for p, _ in parts) == text and [i for _, i in parts[:3]] == [None, 0, 1]
    assert list(_parts("", special)) == [] and list(_parts("x", {})) == [("x", None)]
