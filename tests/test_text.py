import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from labelgrid.functions import labels as lb
from labelgrid.functions import text as tx
from labelgrid.functions import vectors as vec


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


def segments(spark, text):
    return one(spark, tx.semantic_segments(F.col("t")), t=text)


def units(spark, text, mode="full_plus_segments"):
    return [tuple(u) for u in one(spark, tx.text_units(F.col("t"), mode), t=text)]


def test_heading_goes_with_its_block(spark):
    out = segments(spark, "Colores:\n- rojo\n- azul\n\nFiguras:\nUn toro grande.")
    assert out == ["Colores: rojo azul", "Figuras: Un toro grande."]
    assert not any(s.endswith(":") for s in out)


def test_heading_without_body_is_dropped(spark):
    assert segments(spark, "Vacio:\n\nLleno:\nalgo aqui\n\notro bloque") == ["Lleno: algo aqui", "otro bloque"]


def test_sentences_split_and_repeats_dropped(spark):
    out = segments(spark, "Primera frase. Segunda frase. SEGUNDA FRASE.\n\nprimera frase.\n\n¿Otra? Sí.")
    assert out == ["Primera frase.", "Segunda frase.", "¿Otra?", "Sí."]


def test_one_full_unit_and_short_text_once(spark):
    assert units(spark, "Solo una frase corta") == [("full", "Solo una frase corta")]
    out = units(spark, "Uno dos.\n\nTres cuatro.")
    assert [k for k, _ in out] == ["full", "segment", "segment"]
    assert units(spark, "  \n ") == []
    assert units(spark, "Uno. Dos.", "full_description") == [("full", "Uno. Dos.")]
    with pytest.raises(ValueError):
        tx.text_units(F.col("t"), "other")


def test_segments_keep_their_properties(spark):
    rng = random.Random(5)
    pieces = ["Título:", "- uno dos", "* Tres. Cuatro", "", "Una frase. Otra frase! Y más", "ALTO. Alto.", "\t", "• punto", "fin:", "Straße 5. Ñandú"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", tx.semantic_segments(F.col("t")).alias("s")).collect()}
    for i, text in enumerate(texts):
        known = set(re.findall(r"\w+", text))
        assert len({s.casefold() for s in got[i]}) == len(got[i])
        for s in got[i]:
            assert s == " ".join(s.split()) and not s.endswith(":") and set(re.findall(r"\w+", s)) <= known


def test_segments_by_hand(spark):
    cut = lambda t: one(spark, tx.semantic_segments(F.col("t")), t=t)
    assert cut("Colores:\nRojo vivo. Azul mar.\n\nUno.") == ["Colores: Rojo vivo.", "Azul mar.", "Uno."]
    assert cut("- uno\n- dos. Tres") == ["uno dos.", "Tres"]
    assert cut("Solo.") == []


def test_search_tokens_follow_compatibility_forms(spark):
    text = "León ÁÉÍ ß Straße ñandú x² ２０ naïve—Ørsted"
    expected = re.findall(r"[a-z0-9]+", unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower())
    assert one(spark, tx.search_tokens(F.col("t")), t=text) == expected


def test_white_space_is_unicode_aware(spark):
    assert one(spark, tx.norm_ws(F.col("t")), t=" a\t\n b c ") == "a b c"
    assert one(spark, tx.ocr_norm(F.col("t")), t="¡León, 2º  año!") == "león 2º año"
    assert one(spark, tx.strip(F.col("t")), t=" \n x \t") == "x"


def test_line_units(spark):
    assert one(spark, tx.line_units(F.col("t")), t=" a \n\n b\r\nc ") == ["a b c", "a", "b", "c"]
    assert one(spark, tx.line_units(F.col("t")), t=" \n ") == []


def test_notes_are_cleaned(spark):
    html = '<p style="x" onclick="y()">Hi <script>bad()</script><a class="k" href="javascript:alert(1)">a</a> <a href=\'https://x.org/?q=1\' target="_blank">b</a><a name="n">c</a><div>d</div></p>'
    assert one(spark, tx.clean_note(F.col("t")), t=html) == '<p>Hi bad()<a>a</a> <a href="https://x.org/?q=1">b</a><a>c</a>d</p>'
    assert one(spark, tx.note_is_empty(F.col("t")), t="<p>&nbsp; <br></p>") is False  # a break is content, as before
    assert one(spark, tx.note_is_empty(F.col("t")), t="<p>&nbsp;  </p>") is True


def test_notes_let_nothing_unsafe_through(spark):
    clean = lambda t: one(spark, tx.clean_note(F.col("t")), t=t)
    assert clean("<a href='/x\"onclick=alert(1) '>k</a>") == '<a href="/x&quot;onclick=alert(1)">k</a>'
    assert clean("<a href='/x\"y'>k</a>") == '<a href="/x&quot;y">k</a>'
    assert clean("<p/onclick=alert(1)>t</p>") == "<p>t</p>"
    assert clean("t<img/src=x/onerror=alert(1)") == "t"
    assert clean('<a href="java&#115;cript:alert(1)">k</a><a HREF=/y?a=1&amp;b=2>l</a>') == '<a>k</a><a href="/y?a=1&amp;b=2">l</a>'
    assert clean("a < b <!-- x --> c <!-- open") == "a &lt; b  c"
    rng = random.Random(8)
    parts = ["<", ">", "p", "a ", "href=", '"', "'", "/", "javascript:", "https://x", "onclick=", "<a ", "</p>", "<b>", "&", "&#x6a;", " ", "!--", "-->", "img", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.clean_note(F.col("t")).alias("c"))
    grammar = rf"""(?:[^<]|</?(?:{tx.NOTE_TAGS})>|<a href="(?:(?i:https?://|mailto:)|/|#)[^"'<>\s]*">)*"""
    assert [r["c"] for r in df.collect() if not re.fullmatch(grammar, r["c"])] == []


def test_model_replies(spark):
    assert one(spark, tx.clean_model_text(F.col("t")), t='{"a":{"b":"q"},"b":5,"c":"z"}') == "z"
    assert one(spark, tx.clean_model_text(F.col("t")), t='{"a":"x","a":"y"}') == "y"
    clean = tx.clean_model_text(F.col("t"))
    assert one(spark, clean, t='```json\n{"a": "uno", "b": 7, "c": "dos"}\n```') == "uno\ndos"
    assert one(spark, clean, t='{"a": "uno", "b": "dos') == "uno"
    assert one(spark, clean, t="plain text ") == "plain text"
    assert one(spark, clean, t="```markdown\n```markdown extra") == ""


def test_broken_replies_against_a_pattern(spark):
    """The member reader takes what one pattern over the whole text takes, on random quotes, colons and blanks."""
    rnd = random.Random(4)
    texts = ["{" + "".join(rnd.choice(['"', '"', "a", "b ", ":", " : ", ",", "\n", "x"]) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    texts += ['{"a": "uno": "dos", "b" : "tres"', '{5", "k": "v"', '{"": "x", "y": "  "', "{", '{"', '{"a":"b"', '{"a":"b'] + ["```json {" + t for t in ('"a":"b",', '"a" "b": "c"')]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.clean_model_text(F.col("t")).alias("r")).collect()
    for row in rows:
        bare = re.sub(r"```(?:json|markdown)?\s*", "", row["t"].strip()).strip()
        try:
            json.loads(bare)
            continue  # whole objects have a test of their own
        except ValueError:
            values = [v.strip() for v in re.findall(r'"[^"]+"\s*:\s*"([^"]*)"', bare)]
            assert row["r"] == ("\n".join(v for v in values if v) or bare), row["t"]


def test_failed_texts(spark):
    bad = tx.is_failed_text(F.col("t"))
    good = "Texto propio de la etiqueta: " + "x" * 200
    assert [one(spark, bad, t=v) for v in ("", " ERROR ", "corto", good, "z" * 300)] == [True, True, True, False, True]


def test_ids_and_dates_fail_loudly(spark):
    assert one(spark, tx.canonical_id(F.col("t")), t=" 2_08 ") == "2_08"
    for bad in ("6_01", "1_11", "1_1", ""):
        with pytest.raises(Exception, match="invalid id"):
            one(spark, tx.canonical_id(F.col("t")), t=bad)
    assert one(spark, tx.strict_date(F.col("t")), t=" ") is None
    assert str(one(spark, tx.strict_date(F.col("t")), t="2024-02-29")) == "2024-02-29"
    for bad in ("2023-02-30", "2024-2-3", "x"):
        with pytest.raises(Exception, match="invalid date"):
            one(spark, tx.strict_date(F.col("t")), t=bad)


def test_small_fields(spark):
    assert one(spark, tx.slug(F.col("t")), t="  Ñandú & Toro!! ") == "ñandú-toro"
    assert one(spark, tx.slug(F.col("t")), t=" -- ") == "etiqueta"
    assert one(spark, tx.hex_color(F.col("t"), "#000000"), t=" #AaBb01") == "#aabb01"
    assert one(spark, tx.hex_color(F.col("t"), "#000000"), t="red") == "#000000"
    assert one(spark, tx.escape_like(F.col("t")), t="50%_a\\") == "50\\%\\_a\\\\"
    assert one(spark, tx.action_for(F.col("m"), F.col("p")), m="POST", p="/x") == "data_change"
    assert one(spark, tx.client_details(F.col("t")), t='{"source":" web ","screen":"","zzz":1}') == '{"source":"web"}'
    assert one(spark, tx.client_details(F.col("t")), t='{"source":{"x":1},"platform":[1],"screen":7}') == '{"screen":"7"}'
    assert one(spark, tx.client_details(F.col("t")), t="{}") is None
    assert one(spark, tx.html_preview(F.col("t")), t="<b>" + "a" * 200 + "</b>") == "a" * 157 + "…"


def test_label_comparison(spark):
    pairs = [("coche", "coches", True), ("leon", "león", True), ("flor", "flores", True), ("sol", "parasol", True), ("a", "b", True), ("abcde", "abxyz", False), ("gato", "gata", True), ("perro", "gato", False)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    got = [r[0] for r in df.select(lb.similar(lb.tag_norm(F.col("a")), lb.tag_norm(F.col("b")))).collect()]
    assert got == [p[2] for p in pairs]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], {2: 0.0, 5: 1.5, 1: 2.0}), ([0.0, 0.0], {})], "v array<double>, m map<int,double>")
    rows = df.select(vec.l2_normalize(F.col("v")).alias("u"), vec.clean_sparse(F.col("m")).alias("s")).collect()
    assert rows[0]["u"] == pytest.approx([0.6, 0.8]) and rows[1]["u"] == [0.0, 0.0]
    assert [tuple(e) for e in rows[0]["s"]] == [(1, 2.0), (5, 1.5)]


def test_ascii_form_of_every_character(spark):
    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    rows = ["".join(chars[i : i + 500]) for i in range(0, len(chars), 500)] + ["ﬁn Ⅷ ½ ñ ŉ𝐀 x", "", "plain"]
    found = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", tx.to_ascii(F.col("t")).alias("a")).collect()
    assert {r["i"]: r["a"] for r in found} == {i: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for i, t in enumerate(rows)}


def test_hex_colors_of_large_keys(spark, tmp_path):
    """Keys of six hexadecimal digits: even sizes have a colour, odd ones the default."""
    from labelgrid.plans import QUERIES, Tables

    rows = [(0xFFFFF, 2), (0xFFFFF, 1), (0x100000, 1), (0x124F80, 3), (0x124F80, 4)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in QUERIES["hex_colors"](Tables(spark, str(tmp_path))).collect()]
    assert sorted(got) == sorted([(0xFFFFF, "#0fffff"), (0xFFFFF, "#6366f1"), (0x100000, "#6366f1"), (0x124F80, "#6366f1"), (0x124F80, "#124f80")])


def plain_segments(text):
    """Blocks, sentences and first occurrences line by line; white space is Unicode's."""
    space = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    norm = lambda x: re.sub(f"{space}+", " ", x).strip(" ")
    heading = lambda x: re.fullmatch(r"[^.!?]{2,120}:", x)
    blocks = [("", [])]
    for line in map(norm, re.split("\r\n|\r|\n", text)):
        if line == "" or heading(line):
            blocks.append((line, []))
        else:
            blocks[-1][1].append(re.sub("^[-*•] ?", "", line))
    out = {}
    for head, body in blocks:
        joined = norm(" ".join(body))
        for s in re.split(r"(?<=[.!?]) (?=[A-ZÁÉÍÓÚÜÑ0-9])", norm(f"{head} {joined}") if joined else ""):
            if s and s != norm(text) and not heading(s):
                out.setdefault(s.lower().replace("ς", "σ").replace("ß", "ss"), s)
    return list(out.values())


def test_segments_of_odd_white_space_as_a_plain_version_has_them(spark):
    rng = random.Random(26)
    pieces = ["Título:", "-uno  dos", "*\tTres. Cuatro", "\n", "\n\n", "\r\n", "\r", " ", "  ", "\xa0", "\u2003.", "\u2028", "\u3000", "\x85", "\x0b", "\x1c", "A.  B! C?\tD", "ALTO. Alto.", "•", "fin:", "Straße 5. STRASSE 5."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["", "x" * 130 + ":\nUno. Dos."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", tx.semantic_segments(F.col("t")).alias("s")).collect()}
    assert got == {i: plain_segments(t) for i, t in enumerate(texts)}


def test_segments_take_each_step_once(spark):
    """An argument that stands twice in a lambda is worked out twice: the text, the lines and the blocks were."""
    plan = spark.range(1).select(tx.semantic_segments(F.reverse(F.col("id").cast("string"))).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("reverse(") == 1
    assert plan.count("(?U)") <= 2
