"""The codec against the published library, on a model with log probabilities."""

import random

import numpy as np
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from quantloom.llm import pieces
from quantloom.llm.pieces import SPACE

DATA = "/root/testdata/sf0.001"


def unigram(texts, path, seed=3, bytes_too=False):
    """A model of single characters and of random stretches of words, with random log probabilities; nothing is fitted."""
    rng = random.Random(seed)
    found = {c for t in texts for c in t.replace(" ", SPACE)} - {"\n", "\t"}
    for t in texts:
        for w in t.split()[:200]:
            w = SPACE + w
            for _ in range(2):
                a = rng.randrange(len(w))
                found.add(w[a : a + rng.randrange(1, 9)])
    m = proto.ModelProto()
    add = lambda piece, score, kind: m.pieces.add(piece=piece, score=score, type=kind)
    kinds = proto.ModelProto.SentencePiece
    add("<unk>", 0.0, kinds.UNKNOWN)
    add("<s>", 0.0, kinds.CONTROL)
    add("</s>", 0.0, kinds.CONTROL)
    if bytes_too:
        for b in range(256):
            add(f"<0x{b:02X}>", 0.0, kinds.BYTE)
    for p in sorted(found):
        add(p, -rng.uniform(3, 14) - (6 if len(p) == 1 else 0), kinds.NORMAL)
    m.trainer_spec.model_type, m.trainer_spec.vocab_size, m.trainer_spec.byte_fallback = 1, len(m.pieces), bytes_too
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, 1, 2, -1
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", True
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = False, True
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_ids_and_scores_are_those_of_the_library(spark, tmp_path):
    """Whole texts; where ids differ, the sums of scores are one in single precision, which the library adds in."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    for bytes_too in (False, True):
        path = unigram(texts[:60], tmp_path / f"{bytes_too}.model", bytes_too=bytes_too)
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        v = pieces.load(path)
        c = pieces.Codec(v)
        score = lambda ids: sum(v.scores[i] for i in ids)  # noqa: B023, E731
        same = 0
        for t in [*texts, "", " ", "a", "  two  spaces ", "new\nline", "中文 unseen \U0001f600"]:
            want = library.encode(t)
            got = np.frombuffer(c.encode(t), dtype="<i4").tolist()
            same += got == want
            if got != want and not any(v.kinds[i] in "UB" for i in {*got, *want}):
                assert abs(score(got) - score(want)) <= 1e-5 * abs(score(want)) and score(got) >= score(want) - 1e-6 * abs(score(want))
        assert same >= 0.95 * (len(texts) + 6)
    rows = {r.doc_id: r for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert all(rows[r.doc_id].decoded == r.text for r in docs.collect())


def test_parts_met_again_outlast_full_tables(monkeypatch):
    """A part that every text holds is segmented once, however many others fill the tables; what is kept stays bounded."""
    monkeypatch.setattr(pieces, "KEPT", 40)
    v = pieces.Vocabulary(["<unk>", pieces.SPACE, *"abcdefghijklmnopqrstuvwxyz"], [0.0] + [-1.0] * 27, "U" + "N" * 27)
    c, fresh, often = pieces.Codec(v), pieces.Codec(v), []
    once = c.segment_all
    monkeypatch.setattr(c, "segment_all", lambda parts: often.extend(p for p in parts if p == f"{pieces.SPACE}often") or once(parts))
    letters = [f"{x}{y}" for x in "abcdefghij" for y in "klmnopqrst"]
    for k in range(0, 100, 5):
        text = " ".join([*letters[k : k + 5], "often"])
        assert c.encode(text) == b"".join(map(fresh.segment, fresh.parts.findall(pieces.SPACE + text.replace(" ", pieces.SPACE))))
        assert len(c.kept) + len(c.older) <= 40
    assert len(often) == 1
