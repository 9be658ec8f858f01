"""Several models in one session: reused workers encode with the model they are asked for."""

import sentencepiece
from pyspark.sql import functions as F

from tracemill.llm import sentencepiece_scan as S


def varint(raw, at):
    out = shift = 0
    while True:
        b = raw[at]
        out, at, shift = out | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return out, at


def without(model, gone):
    """The model file without the pieces that gone(number, text) names: its first field, repeated, holds the pieces."""
    with open(model, "rb") as f:
        raw = f.read()
    known, out, at, number = sentencepiece.SentencePieceProcessor(model_file=model), b"", 0, 0
    while at < len(raw):
        begin = at
        tag, at = varint(raw, at)
        assert tag & 7 == 2  # every field of the outermost message has a length
        size, at = varint(raw, at)
        at += size
        if tag >> 3 == 1:
            number += 1
            if gone(number - 1, known.id_to_piece(number - 1)):
                continue
        out += raw[begin:at]
    return out


def test_two_models_in_turn(spark, sf, tmp_path):
    other = tmp_path / "fewer.model"
    other.write_bytes(without(S.MODEL, lambda i, x: i > 300 and i % 2 and len(x) > 1))
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text")).repartition(4).cache()
    libraries = {m: sentencepiece.SentencePieceProcessor(model_file=m) for m in (S.MODEL, str(other))}
    assert len({x.get_piece_size() for x in libraries.values()}) == 2
    found = []
    for model in [S.MODEL, str(other)] * 2:
        rows = S.encode(texts, model, decoded="back").collect()
        found.append([r["ids"] for r in rows])
        assert all(r["ids"] == libraries[model].encode(r["text"]) and r["back"] == libraries[model].decode(r["ids"]) for r in rows)
    assert found[0] != found[1]
    # frames that are made first and run in turn later
    frames = [(m, S.encode(texts, m)) for m in libraries] * 2
    for model, df in frames:
        assert all(r["ids"] == libraries[model].encode(r["text"]) for r in df.collect())
    assert S.Vocabulary(S.MODEL).digest == S.Vocabulary(S.MODEL).digest != S.Vocabulary(str(other)).digest
