import io
import json
import random
import time
import zipfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from recordforge.functions import bpe, jsonx, prompts, text
from recordforge.sources.files import decode_office_files, office_text, read_text_files


def chunks_of(spark, *texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.c for r in df.select("i", text.split_paragraphs(F.col("t"), **how).alias("c")).orderBy("i").collect()]


def test_paragraphs(spark):
    assert chunks_of(spark, "short", None, "", "a" * 1000) == [[], [], [], ["a" * 1000]]
    a, b = "One sentence here. " * 15 + "Last one.", "b" * 200
    assert chunks_of(spark, f"{a}\n\n\n{b}", size=300) == [[a, f"Last one.\n\n{b}"]]
    a, b = "x" * 150, "y" * 300
    assert chunks_of(spark, f"{a}\n\n{b}", size=200, overlap=5) == [[a, f"\n\n{b}"]]
    a, b = "x" * 50, "y" * 390
    assert chunks_of(spark, f"{a}\n\n{b}") == [[f"{a}\n\n{b}"]]


def test_paragraphs_lose_none_but_a_short_end(spark):
    rng = random.Random(4)
    wholes = ["\n\n".join("".join(rng.choice("ab .") for _ in range(rng.randint(1, 300))) for _ in range(rng.randint(0, 8))) for _ in range(120)]
    for whole, chunks in zip(wholes, chunks_of(spark, *wholes)):
        held = "\n\n".join(chunks)
        kept = [p for p in whole.strip().split("\n\n") if p.strip()]
        missing = [p for p in kept if p not in held]
        assert len("\n\n".join(missing)) < 100 + 2 * len(missing)


def test_token_windows(spark):
    df = spark.createDataFrame([(0, " ".join(map(str, range(10)))), (1, ""), (2, "  a  "), (3, None)], "id long, t string")
    got = {r.id: r.c for r in df.select("id", text.split_tokens(F.col("t"), 4, 1).alias("c")).collect()}
    assert got == {0: ["0 1 2 3", "3 4 5 6", "6 7 8 9"], 1: [], 2: ["a"], 3: None}


def test_page_text_reads_closed_references_only():
    page = "<title>x &amp;&amp</title><p>a &lt; b &ltc &copy;&copy &ampd; &#65;&#66 &#x43; &am</p>&amp"
    assert text.page_text(page) == "x &&ampa < b &ltc ©&copy &ampd; A&#66 C &am&amp"


def test_page_text_drops_script_and_breaks_at_double_blanks():
    html = "<title>T</title><script>var t='</p>';</script><style>p{}</style><p> a  b </p>\n<p>&amp; c</p><!-- no -->"
    assert text.page_text(html) == "T a\nb\n& c" or text.page_text(html).replace("\n", " ") == "T a b & c"
    assert text.page_text("<p>a<![foo[ b ]]>c<![if x]>d") and text.page_text("<![") is not None and text.page_text(None) is None


def test_html_meta_in_any_order_and_quotes(spark):
    pages = ["<meta content='a > b' name=Description>", '<META NAME="description" content="x"><meta name="description" content="y">', "<meta name='keywords' content='k'>", None]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    got = [r.d for r in df.select("i", text.html_meta(F.col("h"), F.lit("u"))["description"].alias("d")).orderBy("i").collect()]
    assert got == ["a > b", "x", None, None]


def test_routes(spark):
    cases = {"https://x/a.pdf": "pdf", "https://x/watch?v=1.txt": "txt", "https://youtube.com/a.pdf": "youtube", "/d/.pdf": "unsupported", "a.b.HTML": "html", "http://x/": "html"}
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert all(r.got == r.want for r in df.select("want", text.route_documents(F.col("p")).alias("got")).collect())
    names = {"https://youtu.be/v7?t=1": "youtube_v7?t=1.txt", "https://youtube.com/": "youtube_com.txt", "/d/.profile": ".profile.txt", "/d/a.tar.gz": "a.tar.txt"}
    df = spark.createDataFrame(list(names.items()), "p string, want string")
    assert all(r.got == r.want for r in df.select("want", text.output_name(F.col("p")).alias("got")).collect())


JSON_CASES = [
    ('{"a": 1}', '{"a": 1}'), ('see {"a": [1, 2]} there', '{"a": [1, 2]}'), ("[1, 2] tail", "[1, 2]"), ('x\n```json\n{"a": 1}\n```\n', '{"a": 1}'),
    ('```\n{"a": 1}\n```', '{"a": 1}'), ('```python\n{"a": 1}\n```', '{"a": 1}'), ('{"a": "}"}', '{"a": "}"}'), ('{ never [1]', "[1]"), ("none", None), (None, None),
]


BALANCED = {"x [{\"a\":1}] y": '[{"a":1}]', '{ "abc [1,2] ': "[1,2]", 'say "use {x} now': "{x}", "{ [1] {[2]}": "[1]", '{"a": ]1}': '{"a": ]1}', '{"a": "\\"}"}': '{"a": "\\"}"}', "[ { ( ": None}


@pytest.mark.parametrize("reply", BALANCED)
def test_balanced(reply):
    assert jsonx.balanced(reply) == BALANCED[reply]


def test_balanced_is_linear():
    began = time.time()
    for part in ("[", '{"', '{"\\" [', '{"a" '):
        jsonx.balanced(part * 200_000)
    assert time.time() - began < 10


def test_extract_json(spark):
    df = spark.createDataFrame([(r,) for r, _ in JSON_CASES], "r string")
    assert [x.j for x in df.select(jsonx.extract_json(F.col("r")).alias("j")).collect()] == [w for _, w in JSON_CASES]


def test_extract_json_loose_takes_the_leftmost(spark):
    cases = {'x [{"a":1}] y': '[{"a":1}]', 'x {"a":[1]} y': '{"a":[1]}', " 5 ": None, ' {"a":1} ': '{"a":1}', '```json\n[1]\n```': "[1]"}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, r string")
    assert [r.j for r in df.select("i", jsonx.extract_json_loose(F.col("r")).alias("j")).orderBy("i").collect()] == list(cases.values())


BROKEN = ['[{"a": "x \\le y"}]', '[{"a": "line\nbreak\tand tab"}]', '[{"a": "\\alpha\nnext"}]', '[{"a": "bell\x07"}]', '{"a": "$\\{A, B\\}$"}']


@pytest.mark.parametrize("reply", BROKEN)
def test_mend_json_repairs_strings(reply):
    assert json.loads(jsonx.mend_json(reply))


def test_mend_json_keeps_meaning():
    assert json.loads(jsonx.mend_json(BROKEN[0])) == [{"a": "x \\le y"}]
    assert json.loads(jsonx.mend_json(BROKEN[1])) == [{"a": "line\nbreak\tand tab"}]
    assert jsonx.mend_json("{not json") is None
    assert jsonx.mend_json('{"a": NaN, "b": 1e999, "a": -Infinity}') == '{"a": null, "b": null}'
    assert jsonx.mend_json("[" * 100_000) is None and json.loads(jsonx.mend_json('"' + "x" * 2_000_000 + '"'))


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8))
def test_balanced_finds_any_value(value):
    assert json.loads(jsonx.mend_json(jsonx.balanced(f"Sure: {json.dumps([value])} ]"))) == [value]


PERSON = [{"name": "name", "type": "str"}, {"name": "age", "type": "int"}, {"name": "address", "type": "dict", "required": False, "properties": [{"name": "city", "type": "str"}]}]


def test_parse_replies(spark):
    cases = [('[{"name": "a", "age": 3}]', "ok"), ('{"data": [{"name": "a"}]}', "failed"), ('[{"name": "a"}]', "failed"), ("nothing", "failed"), (None, "failed"), ('[{"name": "a", "age": 3, "x": 1}]', "failed")]
    df = spark.createDataFrame([(r,) for r, _ in cases], "reply string")
    got = jsonx.parse_replies(df, "reply", PERSON).select("parse_status", "parse_error").collect()
    assert [g.parse_status for g in got] == [w for _, w in cases]
    assert got[2].parse_error == "0: missing: age" and got[5].parse_error == "0: unexpected: x"


def test_parse_replies_wrapper_and_types(spark):
    df = spark.createDataFrame([('{"data": [{"name": "a", "age": true, "address": {}}]}',)], "reply string")
    assert jsonx.parse_replies(df, "reply", PERSON, wrapper="data").first().parse_status == "ok"
    assert jsonx.parse_replies(df, "reply", PERSON, wrapper="data", type_check=True).first().parse_error == "0: missing: city"
    assert jsonx.parse_replies(df, "reply", PERSON, wrapper="other").first().parse_error == "no object or list"


def test_parse_replies_strict_raises(spark):
    df = spark.createDataFrame([("nothing",)], "reply string")
    with pytest.raises(Exception, match="no JSON found"):
        jsonx.parse_replies(df, "reply", PERSON, strict=True).collect()


def test_schemas():
    assert jsonx.struct_of([{"name": "a", "type": "list", "items": {"type": "int"}}, {"name": "b", "type": "float"}]).simpleString() == "struct<a:array<bigint>,b:double>"
    with pytest.raises(ValueError, match="unknown field type"):
        jsonx.struct_of([{"name": "a", "type": "date"}])
    with pytest.raises(ValueError, match="no name"):
        jsonx.struct_of([{"type": "str"}])
    schema = {"type": "object", "$defs": {"A": {"type": "object", "properties": {"c": {"type": "string"}}}}, "properties": {"a": {"$ref": "#/$defs/A"}, "o": {"anyOf": [{"type": "integer"}, {"type": "null"}]}, "m": {"type": "object", "additionalProperties": {"type": "number"}}}}
    assert jsonx.struct_of_json_schema(schema) == T.StructType.fromDDL("a struct<c:string>, o bigint, m map<string,double>")


def test_check_calls(spark):
    contract = {"name": "f", "parameters": {"a": {"type": "string"}, "n": {"type": "number", "required": False}}}
    cases = [("q", '[{"name": "f", "arguments": {"a": "x"}}]', True, True), ("q", '{"name": "f", "arguments": {"a": "x", "n": 1.5}}', True, True), ("q", '{"name": "f", "arguments": {"a": 1}}', False, False), ("", "[]", True, False), ("q", "", True, False), (None, None, True, False), ("q", "plain words", True, True), ("q", "[1]", False, False), ("q", '[{"name": "f"}]', False, False)]
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _, _) in enumerate(cases)], "i int, q string, a string")
    got = jsonx.check_calls(df, "q", "a", contract).orderBy("i").collect()
    assert [(g.format_ok, g.needs_model) for g in got] == [(f, m) for _, _, f, m in cases]


def test_templates(spark):
    df = spark.createDataFrame([("Rome", None, 1), ("Oslo", "cold", 0)], "city string, note string, n int")
    got = [r.prompt for r in prompts.render_prompt(df, "About {city}{% if note %}: {{ note }}{% endif %}{% if not n %}!{% endif %}").collect()]
    assert got[0].startswith("About Rome\n") and got[1].startswith("About Oslo: cold!\n") and "exactly 1 records" in got[0]


def test_complete_preset(spark):
    df = spark.createDataFrame([("cities", None, ["a", "b"], [], "x"), ("rivers", "Rhine", None, ["c"], None)], "user_instruction string, topic string, good_examples array<string>, bad_examples array<string>, duplicate_examples string")
    got = [r.prompt for r in prompts.render_prompt(df, prompts.complete_preset("data_gen"), num_records=2).collect()]
    assert "Task: cities" in got[0] and '["a","b"]' in got[0] and "faults" not in got[0] and "taken, so write others: x" in got[0] and "topic" not in got[0]
    assert "topic Rhine" in got[1] and '["c"]' in got[1] and "as good as" not in got[1] and "exactly 2 records" in got[1]
    with pytest.raises(ValueError, match="unknown complete preset"):
        prompts.complete_preset("none")


def test_template_errors(spark):
    df = spark.createDataFrame([(None,)], "city string")
    with pytest.raises(ValueError, match="missing required"):
        prompts.render_prompt(df, "{other}")
    assert prompts.render_prompt(df, "{city}").first().prompt_error == "missing required variable: city"
    for bad in ("{% for x in y %}{% endfor %}", "{{ a + b }}", "{% if a %}"):
        with pytest.raises(ValueError):
            prompts.compile_template(bad, {})
    with pytest.raises(ValueError, match="unknown preset"):
        prompts.with_preset("x", "none")


def test_single_braces():
    assert prompts.double_braces('{name} {"a": 1} {{ kept }} {a.b} {not this} {}') == '{{ name }} {"a": 1} {{ kept }} {{ a.b }} {not this} {}'
    assert prompts.variables("{a}{% if b %}{c}{% endif %}{{ d }}") == ({"a", "d"}, {"b", "c"})


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_files():
    w = 'xmlns:w="w"'
    docx = _zip({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:t>Cell</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    assert office_text(docx) == "One\n\nCell"
    xlsx = _zip({"xl/workbook.xml": '<w><sheets><sheet name="S"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>a</t></si></s>", "xl/worksheets/sheet1.xml": '<w><sheetData><row><c t="s"><v>0</v></c><c/><c><v>2</v></c></row></sheetData></w>'})
    assert office_text(xlsx) == "--- Sheet: S ---\na\t2"
    pptx = _zip({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": "<s><sp><t>Title</t></sp><sp><t>Body</t></sp></s>"})
    assert office_text(pptx) == "--- Slide 1 ---\nTitle\nBody"
    assert office_text(b"no archive") is None and office_text(None) is None
    assert office_text(_zip({"word/document.xml": "<a/>"})) == "" and office_text(docx[:60] + b"x" * 20 + docx[80:]) is None
    bad = _zip({"xl/workbook.xml": '<w><sheets><sheet name="S"/></sheets></w>', "xl/worksheets/sheet1.xml": '<w><sheetData><row><c t="s"><v>9</v></c><c t="s"><v>x</v></c><c><v>2</v></c></row></sheetData></w>'})
    assert office_text(bad) == "--- Sheet: S ---\n\t\t2"


def test_decode_office_files_keeps_columns(spark):
    docx = _zip({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:t>é</w:t></w:p></w:body></w:document>'})
    df = spark.createDataFrame([("a", bytearray(docx), 1), ("b", None, 2), ("c", bytearray(b"zip"), None)], "path string, content binary, n int")
    got = decode_office_files(df).orderBy("path").collect()
    assert [(r.path, r.n, r.text) for r in got] == [("a", 1, "é"), ("b", 2, None), ("c", None, None)]


def test_read_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    row = read_text_files(spark, f"{tmp_path}/*.txt").first()
    assert row.text == "one\ntwo" and row.size == 7 and row.path.endswith("a.txt")


BROKEN_PAGES = ["<meta ", '<meta "', "<meta '\"", "<title", "<title>", "<!--", "<", "<a ", "<script>", "&#", "<![", "<!", "<?", "</", '<a b="', '<meta name="description" content="x">']


@pytest.mark.parametrize("piece", BROKEN_PAGES)
def test_broken_pages_take_linear_time(piece):
    began = time.time()
    page = piece * (1_000_000 // len(piece))
    found = text.page_meta(page)
    text.page_text(page)
    assert time.time() - began < 10 and found["description"] == ("x" if "content" in piece else None)


def test_meta_tags_of_broken_pages():
    page = '<meta <p>x" <meta name=description content=a><meta content="b>c" name=Description><title>t\n</title><META PROPERTY="og:type" content=""><meta property=og:type content=later><meta charset=x'
    assert list(text.meta_tags("<meta a='>'><metal><meta b>")) == ["<meta a='>'>", "<meta b>"]
    assert text.page_meta(page) == {"title": "t\n", "description": "a", "type": None, "charset": None}
    assert text.page_meta('<meta content="it\'s"<meta charset="u">') == {"title": None, "description": None, "type": None, "charset": "u"}
    assert text.page_meta(None) == text.page_meta("") == dict.fromkeys(("title", "description", "type", "charset"))


def test_html_meta_of_a_very_long_tag(spark):
    df = spark.createDataFrame([(1, "<meta " + "x" * 1_000_000), (2, '<meta name="description" content="%s">' % ("y" * 1_000_000)), (3, None)], "id int, html string")
    got = {r.id: r for r in df.select("id", *[c.alias(k) for k, c in text.html_meta(F.col("html"), F.lit("http://a.b/c")).items()]).collect()}
    assert got[1].description is None and len(got[2].description) == 1_000_000 and got[3].title is None and got[1].domain == "a.b"


def plain_bpe(data: bytes, ranks: dict) -> list[int]:
    """Merges of the least rank, one after the other."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_bpe_windows_equal_a_plain_encoder(spark, tmp_path):
    import base64

    import regex

    # A small vocabulary: all bytes, then some merges.
    merges = [b"th", b"he", b"the", b" t", b" the", b"\xc3\xa9", b"ab", b"abab", b"  "]
    ranks = {**{bytes([i]): i for i in range(256)}, **{m: 256 + k for k, m in enumerate(merges)}}
    path, pattern = tmp_path / "ranks", r" ?\p{L}+| ?[^\s\p{L}]+|\s+"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    texts = [None, "", "the theme of the  abababab café", "é" * 33, "x" * 50, "\U0001f600 the"]
    decode = {r: t for t, r in ranks.items()}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.w for r in df.select("id", bpe.split_bpe(spark, F.col("text"), str(path), pattern, 7, 2).alias("w")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        tokens = [x for piece in regex.findall(pattern, t) for x in plain_bpe(piece.encode(), ranks)]
        want = []
        for lo in range(0, len(tokens), 5):
            want.append(tokens[lo : lo + 7])
            if lo + 7 >= len(tokens):
                break
        assert [(w.chunk, w.n_tokens) for w in got[i]] == [(b"".join(decode[x] for x in w).decode(errors="replace"), len(w)) for w in want]
    with pytest.raises(ValueError):
        bpe.split_bpe(spark, F.col("text"), str(path), pattern, 5, 5)


def test_bpe_takes_linear_time():
    code = bpe.encoder(bpe.read_ranks("/opt/tokenizers/byte_bpe_50k.tiktoken"), r"\p{L}+|[^\p{L}]+")
    seconds = []
    for n in (200_000, 400_000):
        began = time.time()
        assert sum(len(w) for w in bpe.windows(code.encode_ordinary("ab" * n), 400, 0)) > 0
        seconds.append(time.time() - began)
    assert seconds[1] < 4 * seconds[0] + 1


def test_schema_text():
    told = jsonx.schema_text([{"name": "a", "type": "str", "description": "first"}, {"name": "b", "type": "list", "items": {"type": "dict", "properties": [{"name": "c", "type": "int", "required": False}]}}])
    assert told.split("\n") == ["[", "    {", '    "a": ""  // first (required),', '    "b": [  //  (required)', "      {", '        "c": number  //  (optional)', "      }", "      // ... more items ...", "    ]", "    }", "    ...", "]", "", "Required fields: a, b"]
    tree = {"title": "Tree", "$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "up": {"anyOf": [{"$ref": "#/$defs/node"}, {"type": "null"}], "description": "above"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}}}}}
    told = jsonx.schema_text(tree, wrapper="rows", shown=2)
    assert told.startswith('{\n  "rows": [\n    {\n      "name": ""  //  (required),\n      "up": {}  // above (optional),\n      "kids": [') and told.count('"name"') == 2 and "\n\nTree\n\nRequired fields: name" in told
    assert jsonx.struct_of_json_schema(tree).simpleString() == "struct<name:string,up:variant,kids:array<variant>>"
    with pytest.raises(ValueError):
        jsonx.schema_text([{"name": "a", "type": "odd"}])


def test_booleans_are_no_numbers_if_strict(spark):
    df = spark.createDataFrame([('[{"k": true, "f": false, "b": true}]',)], "j string").select(F.try_parse_json("j").alias("v"))
    fields = [{"name": "k", "type": "int"}, {"name": "f", "type": "float"}, {"name": "b", "type": "bool"}]
    told = lambda strict: df.select(jsonx.validate_items(jsonx.unwrap_json(F.col("v")), fields, True, strict).alias("e")).first().e
    assert told(False) == [] and told(True) == ["0: type: k is boolean", "0: type: f is boolean"]
