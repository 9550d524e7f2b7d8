"""Queries of the optional part, and their SQL where SQL can express them."""

from __future__ import annotations

from symgrove.llm import docpairs, hidden_text, markup, origin, packing, residue, tokenizing
from symgrove.session import cut, ship, table


def p1_found(spark, d):
    """Functions whose own comment describes something."""
    return docpairs.documented_functions(table(spark, d, "symbols")).select("symbol_id").distinct()


def p1_pairs(spark, d):
    """Code-description pairs."""
    return docpairs.documented_functions(table(spark, d, "symbols"))


def p2_found(spark, d):
    """Files that are generated, minified, copied in or data."""
    return origin.file_origins(table(spark, d, "symbols")).filter("origin <> 'hand-written'").select("repo", "file_path")


def p2_origins(spark, d):
    """Every file with its cluster, evidence and verdict."""
    return origin.file_origins(table(spark, d, "symbols"))


def p3_found(spark, d):
    """Fields of doc_nodes in which markup stands."""
    return markup.marked_fields(markup.clean_documents(table(spark, d, "doc_nodes")))


def p3_clean(spark, d):
    """Clean title and content of every row of doc_nodes."""
    return markup.clean_documents(table(spark, d, "doc_nodes")).select("node_id", "clean_title", "clean_content")


#: Small pages and the clean text they must give: menus go by the tree's scores, structure stays.
PAGES: list[tuple[str, str]] = [
    (
        '<html><head><title>t</title></head><body><div class="nav"><ul><li><a href="/a">Home</a></li><li><a href="/b">All the documents of this site</a></li></ul></div>'
        "<div id=\"main\"><h1>Queues &amp; locks</h1><p>The queue keeps every entry until it is read, so nothing is lost.</p><p>Entries leave in order, oldest first.</p><ul><li>one</li><li>two <b>bold</b></li></ul><pre>x = 1\n  y = 2</pre></div>"
        '<div><a href="/c">Next page of the manual</a> <a href="/d">Previous page of the manual</a></div></body></html>',
        "Queues & locks\n\nThe queue keeps every entry until it is read, so nothing is lost.\nEntries leave in order, oldest first.\n- one\n- two bold\n\n    x = 1\n      y = 2",
    ),
    ("# Title\n\nSome **bold** words, a [link](http://x.y/z) and `a_b` with $a^2$.\n\n- item\n\n```c\nfoo();\n```\n> quoted", "Title\n\nSome bold words, a link and a_b with a^2.\n\n- item\n\n    foo();\n\nquoted"),
    ("== Head ==\n'''Bold''' and [[Page|a link]].\n* one\n** two", "Head\n\nBold and a link.\n- one\n  - two"),
    ("\\section{Intro}\nWe use \\emph{care}~\\cite{x}.\n\\begin{equation}\nx = y\n\\end{equation}", "Intro\n\nWe use care.\n\n    x = y"),
    ("std::vector<int> v; a < b && c > d; 3 * 4 * 5; snake_case_name; cost $5 and $6", "std::vector<int> v; a < b && c > d; 3 * 4 * 5; snake_case_name; cost $5 and $6"),
]


def p3_pages(spark, d):
    """Clean text of the small pages."""
    ship(spark)
    pages = spark.createDataFrame([(i, None, x) for i, (x, _) in enumerate(PAGES)], "id long, title string, content string")
    return markup.clean_documents(pages).select("node_id", "clean_content")


def p4_found(spark, d):
    """Languages of the running text in each row of symbols."""
    return hidden_text.text_pieces(table(spark, d, "symbols")).select("symbol_id", "lang").distinct()


def p4_shares(spark, d):
    """Share of each language's running text in each file."""
    return hidden_text.language_shares(table(spark, d, "symbols"))


def p8_ids(spark, d):
    """Token ids of every document."""
    return tokenizing.encode_corpus(table(spark, d, "documents"))


def _profiles(spark, d):
    rows = table(spark, d, "pack_profiles").select("profile", "capacity").limit(packing.MAX_PROFILES + 1).collect()
    return [(r["profile"], int(r["capacity"])) for r in rows]


def p9_packs(spark, d):
    """Containers of every profile and the documents (or their parts) in them."""
    sizes = cut(tokenizing.encode_corpus(table(spark, d, "documents"), counts=True), "sizes")
    return packing.pack(sizes, _profiles(spark, d))


def p9_waste(spark, d):
    """Containers and unused share of every profile."""
    return packing.pack_summary(p9_packs(spark, d), _profiles(spark, d))


def p10_found(spark, d):
    """Documents that are residue."""
    return residue.residue(table(spark, d, "documents")).select("doc_id").distinct()


def p10_labels(spark, d):
    """Documents that are residue, with the kind and how much of the text it is."""
    return residue.residue(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_origins, p3_found, p3_clean, p3_pages, p4_found, p4_shares, p8_ids, p9_packs, p9_waste, p10_found, p10_labels)}



def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


ORACLE: dict[str, str] = {
    "p3_pages": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_literal(x)})" for i, (_, x) in enumerate(PAGES)) + ") AS t(node_id, clean_content)",
}
