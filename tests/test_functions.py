import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.functions import alignment, config, responses, tensors, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [
        ("He didn't take Lynde's hat.", "he didnt take lyndes hat"),
        ("Mr and Dr Blair of St Louis", "mister and doctor blair of saint louis"),
        ("the 5:30 train", "the 5 30 train"),
        ("cotton-warp", "cotton warp"),
        ("'tis", "tis"),
        ("mr.st", "mistersaint"),
        ("street first. £10 Mrs. X", "street first 10 missus x"),
        ("ést st’s", "ést saint s"),
        ("", ""),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize(F.col("t")), t=raw) == want


def test_sentences(spark):
    assert one(spark, text.capitalize_sentences(F.col("t")), t="it was.  so? é. ok. Élan! a") == "It was.  So? é. Ok. Élan! A"
    assert one(spark, text.capitalize_sentences(F.col("t")), t="") == ""
    assert one(spark, text.uppercase_at(F.col("t"), F.array(F.lit(0), F.lit(4))), t="bob met") == "Bob Met"


def test_key_parts(spark):
    assert tuple(one(spark, text.key_parts(F.col("t")), t="1-2-3 A B  C")) == ("1-2-3", "A B  C")
    assert tuple(one(spark, text.key_parts(F.col("t")), t="1-2-3")) == ("1-2-3", "")


def test_minimal_divergence(spark):
    def run(a, b):
        got = one(spark, text.minimal_divergence(F.col("a"), F.col("b")), a=a, b=b)
        return got.ref, got.hyp

    assert run(["a", "c"], ["a", "b", "c"]) == ([], ["b"])
    assert run(["a", "a"], ["a"]) == (["a"], [])
    assert run(["x"], ["y"]) == (["x"], ["y"])
    assert run(["x", "y"], ["x", "y"]) == ([], [])


def test_fences_and_responses(spark):
    assert one(spark, text.strip_code_fences(F.col("t")), t=' ```json\n{"a": 1}\n``` ') == '{"a": 1}'
    assert one(spark, text.strip_code_fences(F.col("t")), t=" plain ``` ") == "plain ```"
    assert responses.flat_object('{"a": 3}') is None
    assert responses.flat_object("{}") == {}
    assert responses.flat_object('{"a": "1"} or {"a": "2"}') == {"a": "2"}
    assert responses.flat_object('{"a": "1", "b": "2"} or {"a": "3"}') == {"a": "1", "b": "2"}
    assert responses.json_spans('x {"a": "}\\""} {"b": {') == ['{"a": "}\\""}']
    assert one(spark, responses.parse_response(F.col("t")), t='ok: {"a": "{x}"}') == {"a": "{x}"}


def test_request_sizes(spark):
    pair = F.array(F.struct(F.lit("k").alias("key"), F.lit("short line").alias("text")))
    for attempt, want in ((1, 1024), (2, 2048), (3, 4096), (9, 16384)):
        assert one(spark, text.max_tokens(text.payload_chars(pair), F.lit(attempt))) == want
    none = F.array().cast("array<struct<key:string,text:string>>")
    assert one(spark, text.user_message(none, pair, "C")) == "1 ID:\nk\tshort line"
    assert one(spark, text.user_message(pair, pair, "C")).startswith("C\nk\tshort line\n\n1 ID")


def test_small_scalars(spark):
    assert one(spark, text.step_of(F.col("t"), F.lit(4)), t="run_Step-120.pt") == 120
    assert one(spark, text.step_of(F.col("t"), F.lit(4)), t="final") == 4
    assert one(spark, text.encoder_frames(F.lit(3000))) == 375
    assert one(spark, text.padded_length(F.lit(81))) == 88
    assert one(spark, text.vocabulary_encode(F.array(F.lit(5), F.lit(9)), F.create_map(F.lit(5), F.lit(0)))) == [0]
    error = F.struct(F.lit("outer").alias("type"), F.lit("").alias("message"), F.struct(F.lit("inner").alias("type"), F.lit("why").alias("message")).alias("error"))
    assert tuple(one(spark, text.error_of(error))) == ("inner", "why")


def brute_align(hyp, ref):
    if not hyp:
        return not ref
    if any(c.isdigit() for c in hyp[0]):
        return any(brute_align(hyp[1:], ref[n:]) for n in range(1, 6) if n <= len(ref))
    return bool(ref) and hyp[0] == ref[0] and brute_align(hyp[1:], ref[1:])


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_alignment_and_edits(spark):
    rng = random.Random(2)
    pairs = [([rng.choice(["a", "b", "7", "x1"]) for _ in range(rng.randint(0, 6))], [rng.choice("ab") for _ in range(rng.randint(0, 9))]) for _ in range(400)]
    df = spark.createDataFrame(pairs, "h array<string>, r array<string>")
    h, r = F.col("h"), F.col("r")
    rows = df.select("h", "r", alignment.aligns(h, r).alias("ok"), alignment.align(h, r).alias("full"), alignment.edit_distance(r, h).alias("e"), alignment.edit_distance_udf(r, h).alias("u")).collect()
    for x in rows:
        assert x.ok == x.full.ok == brute_align(x.h, x.r)
        assert x.e == x.u == brute_edits(x.r, x.h)
        if x.ok:
            assert sum(len(s["words"]) for s in x.full.spans) + sum(not any(c.isdigit() for c in t) for t in x.h) == len(x.r)
    ok, spans = alignment.spans_of("it was 1895".split(), "it was eighteen ninety five".split())
    assert ok and spans == [("1895", ["eighteen", "ninety", "five"])]
    assert alignment.spans_of(["1", "2"], ["a", "b", "c"])[1] == [("1", ["a"]), ("2", ["b", "c"])]


def test_validation_rejects_edits(spark):
    for formatted, plain in (("up stairs", "upstairs"), ("and", "an"), ("naive", "naïve"), ("gonna go", "going to go"), ("1", "one two three four five six")):
        assert not one(spark, alignment.validates(F.col("a"), F.col("b")), a=formatted, b=plain)
    assert one(spark, alignment.validates(F.col("a"), F.col("b")), a="Didn't he, Mr. 5?", b="didn't he mister one two three four five")


def test_spectrogram():
    wave = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    mel = tensors.log_mel(wave)
    assert mel.shape == (80, 100) and mel.max() - mel.min() <= 2.0 + 1e-6
    peak = int(mel.mean(axis=1).argmax())
    centres = 700 * (10 ** (np.linspace(0, 2595 * math.log10(1 + 8000 / 700), 82) / 2595) - 1)
    assert abs(centres[peak + 1] - 1000) < 60


def test_tensor_columns(spark):
    assert one(spark, tensors.mean_pool(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4, 8)]))) == [2.5, 2.0]
    assert one(spark, tensors.mean_pool(F.array().cast("array<double>"))) == []
    got = one(spark, tensors.token_losses(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(2)))
    p = np.exp([0, 0, 1]) / np.exp([0, 0, 1]).sum()
    assert math.isclose(got.loss, -math.log(p[2])) and got.pred == 2 and math.isclose(got.entropy, -(p * np.log(p)).sum())
    assert one(spark, tensors.pad(F.array(F.lit(1)), F.lit(3), F.lit(0))) == [1, 0, 0]
    assert one(spark, tensors.warmup_factor(F.lit(5), F.lit(10))) == 0.5
    assert np.allclose(np.linalg.norm(tensors.rows_in_subspace(np.eye(4), 6, 1), axis=1), 1)


def test_config():
    base = {"a": {"x": 1, "y": [1, 2]}, "lrs": {"p": 1}}
    assert config.merged(base, {"a": {"y": [3]}, "lrs": {"q": 2}}) == {"a": {"x": 1, "y": [3]}, "lrs": {"q": 2}}
