import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom import errors
from tallyloom.functions import u64
from tallyloom.functions.canonical import canonical, canonical_text
from tallyloom.functions.keyed import EnvSecret, Secret, digest64, digest64_hex, hash64, secret_from_env, tool_error_key
from tallyloom.profiles import BloomSpec, HeavySpec, HllSpec, MinHashSpec, domains, is_registered_domain

# Published test vectors (text, domain, secret, canonical hex, digest).
VECTORS = [
    ("tools/call", "mcp-method:v1", "c5-domain-vector-secret", "746f6f6c732f63616c6c", "37ae62771add9e8d"),
    ("session-42", "mcp-session:v1", "c5-domain-vector-secret", "73657373696f6e2d3432", "6815a788758a2790"),
    ("same value", "prompt:v1", "domain-vector-secret", "73616d652076616c7565", "abafdbc7784ca045"),
    ("same value", "user:v1", "domain-vector-secret", "73616d652076616c7565", "3148161270aecd34"),
    ("  Hello, sketchkit!\r\n", "prompt:v1", "example-vector-secret", "48656c6c6f2c20736b657463686b697421", "6709352f3df45c33"),
    (" \t\r\n ", "prompt:v1", "empty-vector-secret", "", "1bfac8e409a6b89b"),
    ("  Hello, sketchkit!\r\n", "prompt:v1", "text-vector-secret", "48656c6c6f2c20736b657463686b697421", "d4cce292568ace52"),
    ("  Café\r\n", "prompt:v1", "unicode-vector-secret", "436166c3a9", "fecf2353fc6ed653"),
]
TOOL_ERROR = ("weather.lookup", "TimeoutError", "c5-domain-vector-secret", "b9777db20cd4aaef")


def test_hash_vectors(spark):
    for text, domain, secret, canon, digest in VECTORS:
        assert canonical_text(text).hex() == canon
        assert digest64(Secret(secret.encode()), domain, canonical_text(text)).hex() == digest
        df = spark.createDataFrame([(text,)], "t string").select(
            F.lower(F.hex(canonical("t").cast("binary"))), digest64_hex(canonical("t"), domain, Secret(secret.encode()), allow_plan_literals=True)
        )
        assert tuple(df.first()) == (canon, digest)


def test_secret_from_the_executors_environment(spark):
    df = spark.createDataFrame([("  Hello, sketchkit!\r\n",), (None,)], "t string")
    hashed = df.select(u64.hex16(hash64(canonical("t"), "prompt:v1", EnvSecret("TALLYLOOM_TEST_SECRET"))))
    assert [r[0] for r in hashed.collect()] == ["6709352f3df45c33", None]
    assert "example-vector-secret" not in hashed._jdf.queryExecution().toString()


def test_tool_error_key(spark):
    tool, error, secret, digest = TOOL_ERROR
    df = spark.createDataFrame([(f" {tool}", f"{error}\n")], "a string, b string")
    assert df.select(digest64_hex(tool_error_key("a", "b"), "tool-error:v1", Secret(secret.encode()), allow_plan_literals=True)).first()[0] == digest
    with pytest.raises(Exception, match="NUL"):
        spark.createDataFrame([("a\0", "b")], "a string, b string").select(tool_error_key("a", "b")).collect()


@pytest.mark.parametrize(("text", "expected"), [("a\rb", "a\nb"), ("\x1ca\x1f", "\x1ca\x1f"), (" a　\u0085", "a"), ("", ""), ("x\r\n\r", "x"), ("a" * 100_000, "a" * 100_000)])
def test_canonical_edges(spark, text, expected):
    assert canonical_text(text).decode() == expected
    assert spark.createDataFrame([(text,)], "t string").select(canonical("t")).first()[0] == expected


def test_canonical_refuses(spark):
    with pytest.raises(errors.InvalidTextError):
        canonical_text(b"\xff")
    with pytest.raises(errors.InvalidTextError):
        canonical_text("\ud800")
    for profile in ("text_v1_casefold", "text_v1_fold_ws", "text_v1_casefold_fold_ws"):
        with pytest.raises(errors.UnsupportedProfileError):
            canonical("t", profile)
    with pytest.raises(Exception, match="UTF"):
        spark.createDataFrame([(bytearray(b"\xff"),)], "t binary").select(canonical("t")).collect()
    assert spark.createDataFrame([(None,)], "t string").select(canonical("t")).first()[0] is None


def test_secrets(monkeypatch):
    with pytest.raises(errors.EmptySecretError):
        secret_from_env("")
    with pytest.raises(errors.EmptySecretError):
        secret_from_env("NO_SUCH_VARIABLE_HERE")
    for weak in ("short", "demo-secret-change-me", "dev-secret-change-me"):
        monkeypatch.setenv("WEAK", weak)
        with pytest.raises(errors.WeakSecretError):
            secret_from_env("WEAK")
    assert "vector" not in repr(Secret(b"example-vector-secret")) + str(Secret(b"example-vector-secret"))
    with pytest.raises(errors.WeakSecretError):
        hash64("t", "prompt:v1", Secret(b"example-vector-secret"))


def test_domains_and_profiles():
    assert len(domains()) == 8 and is_registered_domain("user:v1") and not is_registered_domain("user:v2")
    with pytest.raises(errors.UnregisteredDomainError):
        HllSpec("small", "other")
    with pytest.raises(errors.UnsupportedProfileError):
        HeavySpec("k256")
    with pytest.raises(errors.UnsupportedAlgorithmError):
        BloomSpec("small", "user:v1", "siphash_64")
    with pytest.raises(errors.PrecisionMismatchError):
        HllSpec("micro").require_same(HllSpec("small"))
    with pytest.raises(errors.IncompatibleMergeError):
        MinHashSpec("small").require_same(MinHashSpec("default"))


def test_seeds_follow_from_the_mixer():
    assert u64.mix64_int(0) == 0
    assert u64.family_int(5, u64.BLOOM_SEED, 2) == u64.mix64_int(5 ^ u64.mix64_int(u64.BLOOM_SEED ^ 2))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, u64.MASK), min_size=1, max_size=200))
def test_unsigned_arithmetic(spark, values):
    edges = [0, 1, 1 << 63, u64.MASK, (1 << 32) - 1, 1 << 32]
    values = values + edges
    x = F.col("x")
    df = spark.createDataFrame([(u64.signed(v),) for v in values], "x long")
    rows = df.select(u64.mix64(x), u64.modulo(x, 143_776), u64.hex16(x), u64.from_hex16(u64.hex16(x)), u64.ordered(u64.ordered(x))).collect()
    for v, (mixed, rest, text, back, same) in zip(values, rows, strict=True):
        assert mixed == u64.signed(u64.mix64_int(v)) and rest == v % 143_776
        assert text == f"{v:016x}" and back == same == u64.signed(v)


def test_trimming_long_inner_blanks_is_fast(spark):
    import time

    text = "a" + " " * 200_000 + "b　\n"
    start = time.time()
    assert spark.createDataFrame([(text,)], "t string").select(canonical("t")).first()[0] == text[:-2]
    assert time.time() - start < 20


def test_other_types_are_no_text(spark):
    with pytest.raises(Exception, match="no text but"):
        spark.createDataFrame([(1,)], "n long").select(canonical("n")).collect()
