"""Problems 1, 3, 4 and 10: cases by rule, held-out accuracy, edge cases."""

import pytest

from symgrove.llm import docpairs as D
from symgrove.llm import hidden_text as H
from symgrove.llm import langid as G
from symgrove.llm import lexing as X
from symgrove.llm import markup as M
from symgrove.llm import residue as R

FUNC = "int findRow(int key) { return lookup(\"}{\", '}', key); }"


@pytest.mark.parametrize(
    "fam,code,found",
    [
        ("cpp", "/// Returns how many rows are left.\n\n" + FUNC, True),
        ("cpp", "/** Returns how many rows are left. */\ntemplate <class T>\n[[nodiscard]]\n" + FUNC, True),
        ("cpp", "/*!\n * @return how often the table was read\n */\r\n" + FUNC, True),
        ("cpp", "// Returns how many rows are left.\n" + FUNC, False),
        ("cpp", "/* Returns how many rows are left. */\n" + FUNC, False),
        ("cpp", "/// Find the row.\n" + FUNC, False),
        ("cpp", "/// findRow()\n" + FUNC, False),
        ("cpp", "/// TODO: document\n" + FUNC, False),
        ("cpp", "/// Counts all rows of a table twice. TODO: faster\n" + FUNC, True),
        ("cpp", "/// @param key\n/// @return\n" + FUNC, False),
        ("cpp", "/// Copyright (c) the authors. All rights reserved.\n" + FUNC, False),
        ("cpp", "/// This file was generated by a tool.\n" + FUNC, False),
        ("cpp", "/// ==========================\n" + FUNC, False),
        ("cpp", "/// int old = findRow(key);\n" + FUNC, False),
        ("cpp", "/// 返回扫描之后剩余的条目数量。\n" + FUNC, True),
        ("cpp", "/// 待补充\n" + FUNC, False),
        ("cpp", "/// Licensed under the terms of X.\n\n/** Counts the rows which are still locked. */\n" + FUNC, True),
        ("java", "/** Liefert die Anzahl der Zeilen. */\n@Override\npublic " + FUNC, True),
        ("java", "// Returns how many rows are left.\npublic " + FUNC, False),
        ("script", "/** {@inheritDoc} */\nfindRow(key: int): int { return 1 }", False),
        ("go", "// Returns how many rows are left.\nfunc (s *T) findRow(key int) int {\n return 1\n}", True),
        ("go", "// Returns how many rows are left.\n\nfunc findRow(key int) int { return 1 }", False),
        ("python", '@traced\n# Returns nothing useful at all here.\ndef find_row(key):\n    """Return how many rows are left."""\n    return 1', True),
        ("python", "def find_row(key):\n    '''Find the row.'''\n    return 1", False),
        ("python", "# Return how many rows are left.\ndef find_row(key):\n    return 'Return how many rows are left'", False),
    ],
)
def test_documented(fam, code, found):
    got = D.capture(code, fam)
    assert bool(D.description(got[0], "findRow" if fam != "python" else "find_row")) is found


def test_capture_balances_and_protects_strings():
    doc, sig, code = D.capture('/// One two three.\nint f(int a = g("(")) { if (x) { s = R"(})"; } /* } */ return 1; }\nint h() {}', "cpp")
    assert doc == "One two three." and sig == 'int f(int a = g("("))' and code.endswith("return 1; }")
    assert D.capture("/// Cut off here.\nint f() { if (", "cpp")[1] == "int f()"
    assert D.capture("x = 1", "python") is None


SYMBOLS = "id long, repo string, name string, kind string, definition string, file_path string, language string, parent_class string, recorded_at string"


def symbols(spark, rows):
    return spark.createDataFrame([(i, "r", n, k, d, p, g, None, "x") for i, n, k, d, p, g in rows], SYMBOLS)


def test_pairs_frame(spark):
    good = "/// Returns how many rows are left.\n" + FUNC
    s = symbols(spark, [(1, "findRow", "function", good, "a.cpp", None), (1, "findRow", "function", good, "a.cpp", None), (2, None, "method", good, None, "C++"), (3, "f", "function", None, "a.cpp", "cpp"), (4, "f", "function", "", "a.cpp", "cpp"), (5, "C", "class", good, "a.cpp", "cpp"), (6, "f", "function", "/// Long text of many words.\n" + "int f() {" + "x();" * 50000 + "}", "a.cpp", "")])
    rows = D.documented_functions(s).collect()
    assert sorted(r.symbol_id for r in rows) == [1, 1, 2, 6] and rows[0].description == "Returns how many rows are left."
    assert D.documented_functions(s.limit(0)).count() == 0


HELD_OUT = {
    "en": ["The parser stops at the first broken line and keeps the rest.", "nobody has opened this door yet", "Sorts the names before printing"],
    "de": ["Der Zerteiler hält bei der ersten kaputten Zeile an.", "noch niemand hat diese Tür geöffnet", "Sortiert die Namen vor dem Drucken"],
    "fr": ["L'analyseur s'arrête à la première ligne cassée.", "personne n'a encore ouvert cette porte", "Trie les noms avant l'impression"],
    "es": ["El analizador se detiene en la primera línea rota.", "nadie ha abierto todavía esta puerta", "Ordena los nombres antes de imprimir"],
    "ru": ["Разбор останавливается на первой испорченной строке.", "эту дверь ещё никто не открывал"],
    "zh": ["解析器在第一行损坏处停止。", "还没有人打开过这扇门"],
    "ja": ["解析は最初の壊れた行で止まります。", "このドアはまだ誰も開けていない"],
}


def test_language_of_held_out_texts():
    cases = [(k, t) for k, v in HELD_OUT.items() for t in v]
    assert sum(G.language(t) == k for k, t in cases) >= len(cases) - 1
    assert G.language("123 ...") is None


@pytest.mark.parametrize(
    "text,is_text",
    [("cannot open the index", True), ("cannot open: %s", False), ("giving up after 3 attempts: {}", True), ("SELECT id, name FROM table WHERE id = ?", False), ("a,b,c", False), ("--max-queue", False), ("/var/lib/x/y.idx", False), ("^[a-z]+\\.x$", False), ("x = f(y) + 1;", False), ("two words", False), ("索引已经过期了", True), ("索引过期", False), ("yyyy-MM-dd HH:mm:ss", False), ("for x in rows:", False), ("return the value;", False)],
)
def test_running_text(text, is_text):
    assert bool(X.running_text(text)) is is_text


def test_pieces():
    code = '// The first line goes on\n// over a second line here.\nf("one two " "three four"); /* Das ist noch nicht fertig. */ g("\\u7d22\\u5f15\\u5df2\\u7ecf\\u8fc7\\u671f\\u4e86");'
    got = [(g, k) for g, k, _ in H.texts(code, "cpp")]
    assert got == [("en", "comment"), ("en", "string"), ("de", "comment"), ("zh", "string")]
    assert H.texts("x = 'https://a.b/c'  # @param key the table to read from", "python")[0][0] == "en"


def test_text_frames(spark):
    s = symbols(spark, [(1, "f", "function", "/// Returns how many rows are left.\n" + FUNC, "a.cpp", "cpp"), (2, "v", "variable", 'x = "noch nicht fertig gelesen"', "b.py", None), (3, "n", "field", None, None, None), (4, "e", "field", "", "b.py", "")])
    assert sorted((r.symbol_id, r.lang) for r in H.text_pieces(s).collect()) == [(1, "en"), (2, "de")]
    share = {(r.file_path, r.lang): r.share for r in H.language_shares(s).collect()}
    assert 0 < share[("a.cpp", "en")] < 1 and share[("b.py", "de")] == pytest.approx(26 / 32, abs=0.01)
    assert H.language_shares(s.limit(0)).count() == 0


MARKED = ["<b>x</b> y", "a<br/>b", "R&amp;D", "&#8211;", "# Head", "Title\n=====", "**bold** x", "~~old~~", "`code` x", "[a](b.md)", "![a](img/b.png)", "x[^1]", "> quote", "```\ncode\n```", "- [x] done", "* item one", "| a | b |\n|---|---|", "== head ==", "'''bold''' x", "''it'' x", "[[a|b]]", "{{note|x}}", "{| class=x", "[[Category:x]]", "\\section{x}", "\\textbf{x} y", "$O(n)$", "$$x^2$$", "\\[ a = b \\]", "x~\\cite{y}", "{\\tt x}", "\\item x", "<a href='x'>y</a>", "<!-- c -->", "{code}\nx\n{code}", "H<sub>2</sub>O", "[ab x][bc]", "*it is* so", "复杂度$O(n)$的", "见[图表][ab]。", "这是*斜体*字"]
PLAIN = ["a < b && c > d", "vector<int> v", "std::map<std::string, Page> m", "read <stdin> now", "see <header> or <source>", "costs $5 or $6", "$HOME is set", "R&D", "C# and F#", "a * b * c", "ptr* p", "(*p)[3]", "__main__", "snake_case_name", "a[i] = b[2]", "[36]", "C:\\data\\x\\y.idx", "~/.x/y", "#3754", "x|y", "{a, b}", "x^2 + y_1", "100% of it", "key=a;b=c", "- item", "1. item", "operator< for x", "Vec<T>", "header's", "a -> b", "[[nodiscard]] int f()", ""]


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found_and_goes(text):
    clean, _, marks = M.convert(text)
    assert marks and not (M.convert(clean)[2] and "latex" not in marks)


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_stays(text):
    clean, _, marks = M.convert(text)
    assert not marks and clean == text


def test_structure_is_kept():
    src = "<div><ul><li><a href='a'>Home page of it all</a></li><li><a href='b'>All other pages there are</a></li></ul></div><div><h2>Head</h2><p>A long paragraph, with commas, and much more text than the menu has, so that it wins.</p><ul><li>one</li><li>two</li></ul><pre><code>x = 1;\n  y</code></pre></div>"
    clean, blocks, _ = M.convert(src)
    assert [b[0] for b in blocks] == ["heading", "text", "item", "item", "code"] and "Home page" not in clean and "    x = 1;\n      y" in clean
    assert M.convert("\\begin{equation}\n a = \\frac{b}{c}\n\\end{equation}")[1] == [("formula", 0, "a = \\frac{b}{c}")]
    assert M.convert("a\n```\n# no head <b>\n```\nb")[1][1] == ("code", 0, "# no head <b>")
    assert M.convert_line("== a `b` ==")[0] == "a b"


def test_clean_frame(spark):
    n = spark.createDataFrame([(1, "<b>t</b>", None, 5), (1, "<b>t</b>", None, 5), (2, None, "", 5), (3, "x", "&amp; " * 50000, 5)], "id long, title string, content string, node_id int")
    c = M.clean_documents(n)
    assert c.count() == 4
    assert sorted(tuple(r) for r in M.marked_fields(c).collect()) == [(1, "title"), (3, "content")]
    assert M.marked_fields(M.clean_documents(n.limit(0))).count() == 0


BODY = "The parser keeps every table in memory. It writes the journal before the cache is released, and the caller waits. Rows are sorted twice.\n"
RESIDUE = [
    ("404 Not Found\n\nThe page you asked for could not be located on this server.", "error"),
    ("Menu\nLogin\nPlease enable JavaScript to view this page.\n© some-name maintainers", "script"),
    ("Lorem ipsum dolor sit amet consectetur. Magna elit velit justo.", "filler"),
    ("Content coming soon. " * 40, "filler"),
    ("Zugriff verweigert. Bitte melden Sie sich an.", "error"),
    ("服务器内部错误，请稍后再试。", "error"),
    ("Maintained by {{owner}} since 2020.\n" + BODY, "template"),
    ("Version [version goes here]\n" + BODY, "template"),
    ("Welcome to <YOUR NAME>.\n" + BODY, "template"),
    ("关于{module_title}的说明\n" + BODY, "template"),
    ("关于__OWNER__的说明\n" + BODY, "template"),
]
REAL = [BODY, "", "   ", "x", "....", "The gateway answers 404 Not Found when the index is missing; clients should retry.\n" + BODY, "Write `{{owner}}` inside code marks.\n" + BODY, "    title: {{owner}}\n" + BODY, "The macro __FILE__ expands to the path.\n" + BODY, "export X=${HOME}/y\n" + BODY, 'Old readers show "Please enable JavaScript" instead.\n' + BODY]


def test_residue(spark):
    rows = [(i, t, "c") for i, (t, _) in enumerate(RESIDUE)] + [(100 + i, t, "c") for i, t in enumerate(REAL)] + [(200, None, "c"), (0, RESIDUE[0][0], "c"), (201, BODY * 2000, "c")] + [(300 + i, BODY, "c") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted((r.doc_id, r.label) for r in R.residue(d).collect())
    assert got == sorted([(i, k) for i, (_, k) in enumerate(RESIDUE)] + [(0, "error")])
    assert R.residue(d.limit(0)).count() == 0


def strings(code, fam):
    return [t for k, _, _, t in X.pieces(code, fam) if k == "string"], [t for k, _, _, t in X.pieces(code, fam) if k == "comment"]


def test_lexers_know_their_language():
    assert strings('auto s = R"x(say ")" and more)x"; int a = 1\'000\'000; char c = \'y\'; // end', "cpp") == (['say ")" and more', "y"], ["end"])
    assert strings("x := `C:\\` // behind it\n", "go") == (["C:\\"], ["behind it"])
    assert strings('String s = """\n  He said "go" now.\n  """; // c', "java") == (['\n  He said "go" now.\n  '], ["c"])
    assert strings('const a = `x ${f(`in ${y} "q"`)} done`; let r = /[{"\\/]/g; // tail\nx = a / b / c; "str"', "script") == (['x ${f(`in ${y} "q"`)} done', "str"], ["tail"])
    assert strings("x = r'a\\d' # no\n", "python") == (["a\\d"], ["no"])
    assert strings('"open\nint x; /* never closed', "cpp") == ([], ["never closed"])


def test_other_languages_are_rejected():
    for text in ("Il file non è stato trovato nella cartella", "Het bestand kan niet worden gelezen", "O arquivo não pode ser lido agora", "파일을 찾을 수 없습니다 다시 시도하세요", "Δεν βρέθηκε το αρχείο", "Nie można otworzyć tego pliku"):
        assert G.language(text) is None
    for text, lang in (("read the file again", "en"), ("Die Datei wurde nicht gefunden", "de"), ("El archivo no puede leerse", "es"), ("le fichier est absent", "fr"), ("файл не найден снова", "ru"), ("找不到该文件请重试", "zh"), ("ファイルが見つかりません", "ja")):
        assert G.language(text) == lang


def test_bodies_with_brackets_in_strings_are_whole():
    for code, fam in (
        ('/** Says it. */\nString f() {\n  return """\n  a } "b" {\n  """;\n}', "java"),
        ('/** Says it. */\nfunction f(a) { return /[{"]/.test(a) ? `x ${a ? `}` : "{"}` : 1 / 2; }', "script"),
        ('/// Says it.\nint f() { auto s = R"x(} ")x"; return 1\'000; }', "cpp"),
        ("// Says it.\nfunc f() { s := `{\\` }", "go"),
        ("/// Says it.\nint f() { if (a) { b", "cpp"),
    ):
        doc, _, body = D.capture(code, fam)
        assert doc == "Says it." and body == code.split("\n", 1)[1]


def test_markup_of_any_depth():
    text = "<div>" * 5000 + "deep text, long enough to be one paragraph of its own" + "</div>" * 5000
    assert M.convert(text)[0] == "deep text, long enough to be one paragraph of its own"
    assert M.convert("</p></div>" * 2000 + "<ul>" * 3000)[0] == ""
