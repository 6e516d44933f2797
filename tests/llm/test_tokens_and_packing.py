import random
import struct
import zlib

from tokenizers import Tokenizer

from lineside.llm import packing, tokens

NAME = "word_bpe_49k.json"
PIECES = list("abXYéÉßΣσςİK '’\"!?.,;:-_<|>()0123٣½ \t\n\x0b\x1c\x85\xa0​́中本한🙂ﬁ") + [
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "don't", " the "]


def library():
    return Tokenizer.from_file(tokens.tokenizer_path(NAME))


def mixed_rows():
    rng = random.Random(3)
    return [(100 + i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50)))) for i in range(400)]


def test_counts_equal_the_library(documents, odd_rows):
    rows = odd_rows + mixed_rows()
    got = tokens.token_counts(documents(rows), limit=20, head=30).collect()
    tk = library()
    want = sorted((str(d), len((t or "").encode()), n := len(tk.encode(t or "", add_special_tokens=False)), n > 20) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_counts_of_nothing(documents):
    assert tokens.token_counts(documents([])).count() == 0


def test_packing_round_trip(documents, odd_rows):
    rows = [r for r in odd_rows + mixed_rows() if r[0] not in (None, 12, 13)]
    got = packing.pack(documents(rows).repartition(3), size=64, windows=4, slack=4, keep_ids=True).collect()
    tk, by = library(), {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in rows:
        ids = tk.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by[doc], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == struct.pack(f"<{len(ids)}I", *ids)
        assert [r.start for r in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert all(r.doc_tokens == len(ids) and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in pieces)
    check_sequences(got, 64, 0.1)


def check_sequences(rows, size, padding):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= size
    assert sum(r.length for r in rows) >= (1 - padding) * size * len(seqs)


def test_packing_repeated_rows_and_nothing(documents):
    got = packing.pack(documents([(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sorted(r.length for r in got) == [1, 3, 3] and len({r.sequence_id for r in got}) == 1
    check_sequences(got, 2048, 1)
    assert packing.pack(documents([])).count() == 0


def test_packer_keeps_few_windows_open():
    rng, packer = random.Random(1), packing.Packer(100, 5, 3, 0)
    total = 0
    for doc in range(2000):
        n = rng.randint(1, 250)
        total += n
        packer.add(doc, 0, n, b"\0\0\0\0" * n)
        assert len(packer.open) <= 5
    packer.close()
    assert sum(r[2] for r in packer.out) == total and packer.next_id <= 1.03 * total / 100 + 1


def test_every_code_point_as_the_library_has_it():
    """Each code point alone, within a word, beside marks and doubled, and strings of random ones; ids and counts."""
    tk, rng = library(), random.Random(17)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"ab{c}c {c} {c}{c}x .{c}! {c}1" for c in points[:0x3400] + points[0xA000:0x10000] + points[0x10000:0x20000:3]]
    texts += ["".join(rng.choice(points) + rng.choice(["", "", " ", "a", "."]) for _ in range(30)) for _ in range(3000)]
    texts += ["a\u0558b \ua7ce \U000107bb1 it's\u209d"]
    for at in range(0, len(texts), 2000):
        block = texts[at:at + 2000]
        want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tk.encode_batch(block, add_special_tokens=False)]
        assert list(packing.encoded(block, NAME)) == want
        words = [[p for w in tokens.words_and_specials(t)[0] for p in tokens.pre_tokens(w, NAME)] for t in block]
        counts = dict(zip(known := sorted({p for row in words for p in row}), tokens.piece_counts(known, NAME)))
        assert [sum(map(counts.__getitem__, row)) + tokens.words_and_specials(t)[1] for row, t in zip(words, block)] == [len(w) // 4 for w in want]


def test_odd_characters_do_not_end_the_job(documents):
    rows = [(1, "plain words"), (2, "a\u0558b \ua7ce mojibake"), (3, "\U000107bb")]
    got = {r.doc_id: r for r in packing.pack(documents(rows), keep_ids=True).collect()}
    for doc, text in rows:
        ids = library().encode(text, add_special_tokens=False).ids + [1]
        assert bytes(got[doc].ids) == struct.pack(f"<{len(ids)}I", *ids)
