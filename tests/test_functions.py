import random
import re

from pyspark.sql import functions as F

from quern import functions
from quern.functions import text as T
from quern.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_match_the_driver_side(spark):
    rng = random.Random(1)
    texts = ["AuthService.verify_jwt_token(requestHeader)", "", "HTTPServer a1B", "__x__ _", "é_aB", *("".join(rng.choice("aB1_ é.Z") for _ in range(40)) for _ in range(50))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.tokenize_code(F.col("t")).alias("x")).collect():
        assert r["x"] == T.tokenize(r["t"])
    assert {"authservice", "auth", "service", "verify", "jwt", "token", "request", "header"} <= set(T.tokenize(texts[0]))
    functions.register(spark)
    assert spark.sql("SELECT tokenize_code('aB_c') AS t, cosine_similarity(array(1D, 0D), array(1D, 0D)) AS c, rrf_score(1, 1D, 60) AS r, normalize_symbol(' a::b->c ') AS s").first().asDict() == {"t": ["ab_c", "ab", "c", "a", "b_c"], "c": 1.0, "r": 1 / 61, "s": "a.b.c"}


def test_lines(spark):
    for t in ("", "a", "a\n", "a\r\nb\rc\n\nd", "x\u2028y\x0bz", "\n"):
        assert one(spark, T.splitlines(F.lit(t))) == t.splitlines()


def test_ids_documents_and_paths(spark):
    lit = F.lit
    assert one(spark, T.chunk_id(lit(""), lit("a/b.py"), lit("A::B"), lit("f"))) == "a/b.py::A::B::f"
    assert one(spark, T.chunk_id(lit("r"), lit("b.py"), lit(""), lit("f"))) == "r::b.py::f"
    doc = T.render_document(lit("b.py"), lit("A"), lit("f"), lit("Doc."), lit("x = 1"))
    assert one(spark, doc) == "File: b.py\nClass: A\nMethod: f\nDocstring: Doc.\nCode:\nx = 1"
    assert one(spark, T.code_of_document(doc)) == "x = 1"
    assert one(spark, T.render_document(lit("b.py"), lit(""), lit("f"), lit(None).cast("string"), lit("y"))) == "File: b.py\nMethod: f\nCode:\ny"
    assert [one(spark, T.language_of(lit(p))) for p in ("a.PY", "x/b.tsx", "c.toml", ".py", "d.d/e", "f.test.cc")] == ["python", "tsx", None, None, None, "cpp"]
    assert one(spark, T.go_receiver(lit("(s *Server)"))) == "Server" and one(spark, T.go_receiver(lit("(Server)"))) == "Server"
    assert one(spark, T.strip_string_literal(lit('r"""\n Hi. \n"""'))) == "Hi." and one(spark, T.strip_string_literal(lit("'x'"))) == "x"


def test_messages(spark):
    lit = F.lit
    assert one(spark, T.encode_message(lit('{"é":1}'))) == 'Content-Length: 8\r\n\r\n{"é":1}'
    assert one(spark, T.path_to_uri(lit("C:\\a\\b.py"))) == "file:///C:/a/b.py" and one(spark, T.uri_to_path(lit("file:///C:/a%20b.py"))) == "C:/a b.py"
    place = '{"uri":"file:///a.py","range":{"start":{"line":9,"character":4},"end":{"line":14,"character":0}}}'
    link = '[{"targetUri":"file:///b.py","targetRange":{"start":{"line":1,"character":0},"end":{"line":2,"character":0}},"targetSelectionRange":{"start":{"line":19,"character":0},"end":{"line":20,"character":1}}}]'
    assert one(spark, T.parse_locations(lit(place)))[0].asDict() == {"file": "/a.py", "start_line": 10, "start_character": 4, "end_line": 15, "end_character": 0}
    assert one(spark, T.parse_locations(lit(link)))[0]["start_line"] == 20 and one(spark, T.parse_locations(lit(None).cast("string"))) == []
    assert [one(spark, T.hover_text(lit(x))) for x in ('"a"', '{"value":"b"}', '["a",{"value":"b"}]')] == ["a", "b", "a\nb"]


def test_symbols(spark):
    df = spark.createDataFrame([("auth::Svc", "login"), ("", "login"), ("Pay", "login"), ("Svc", "out")], "chain string, name string")
    found = lambda t: df.where(T.matches_definition(F.col("name"), F.col("chain"), t)).count()
    assert [found(t) for t in ("login", "Svc.login", "auth::Svc::login", "vc.login", "Pay.login", "x")] == [3, 1, 1, 0, 1, 0]
    assert one(spark, T.symbol_suffixes(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"]


def test_vectors(spark):
    a = F.array(*map(F.lit, (3.0, 4.0)))
    assert one(spark, V.l2_normalize(a)) == [0.6, 0.8] and one(spark, V.l2_normalize(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0 and one(spark, V.cosine(a, F.array(F.lit(1.0)))) is None
    nine = F.array(*map(F.lit, (1.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 1.0)))
    assert one(spark, V.quantize_ubinary(nine)) == [129, 128] and one(spark, V.quantize_binary(nine)) == [1, 0]
    assert one(spark, V.hamming(F.array(F.lit(255)), F.array(F.lit(15)))) == 4
    wide = spark.createDataFrame([([0.0] * 383 + [float(i)],) for i in range(3)], "v array<double>")
    codes = wide.crossJoin(V.range_arrays(wide, "v")).select(V.quantize_int8(F.col("v"), F.col("ranges")).alias("q")).collect()
    assert {len(r["q"]) for r in codes} == {384} and sorted(r["q"][383] for r in codes) == [-128, -1, 127] and codes[0]["q"][0] == 0
    text = F.lit("aB aB c")
    got = one(spark, V.hash_embedding(T.tokenize_code(text), 16))
    assert abs(sum(x * x for x in got) - 1) < 1e-12 and re.fullmatch(r"\d", str(sum(x > 0 for x in got)))
