"""Nested boolean queries for a whole table of queries.

A query is a tree, a row for each node: ``query_id``, ``node`` (a number of its own in the query), ``parent`` (null for the
root), ``occur``, ``kind``, ``field``, ``text``. A leaf's kind is one of ``search.KINDS``; an inner node's is ``group``. What a
node is to its parent says how groups combine:

=========  ==================================================================
must       the parent's documents have it; its score is added
should     its score is added; one is needed if there is no must or filter
filter     the parent's documents have it; it adds no score
must_not   the parent's documents do not have it
=========  ==================================================================

So OR is should and should, AND is must and must, ANDNOT must and must_not, ANDMAYBE must and should, REQUIRE must and
filter. A group of nothing but must_not has no documents.

The leaves of all queries are answered together, by one read of the postings. Then the tree is climbed a level at a time, one
aggregate over (query, parent, document) for each, whatever the number and shape of the queries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.operators.index import Index
from fathom.operators.ranking import COORD, KEYS
from fathom.operators.search import KINDS, PAGE_LEN, clause_hits, clause_terms, index_of_clauses, page_totals_of, search_page
from fathom.operators.snippets import snippet_or_fallback, with_snippet
from fathom.plans.lineage import cut_lineage

OCCURS = ("must", "should", "filter", "must_not")
NODE = "query_id int, node int, parent int, occur string, kind string, field string, text string"


# ---- trees --------------------------------------------------------------------------------------------------------------

def placed_nodes(nodes: DataFrame) -> tuple[DataFrame, int]:
    """``nodes`` with ``level`` (0 for roots) and ``live`` (it and all above it add score), and the depth of the deepest tree.

    A round for each level, over the nodes alone. Nodes without a way to a root, and unknown kinds, are errors.
    """
    nodes = cut_lineage(nodes)
    if unknown := {r[0] for r in nodes.select("kind").distinct().limit(100).collect()} - {*KINDS, "group"}:
        raise ValueError(f"no such kinds of nodes: {sorted(map(str, unknown))}")
    adds = F.col("occur").isin("must", "should")
    found = here = cut_lineage(nodes.filter("parent IS NULL").withColumns({"level": F.lit(0), "live": F.lit(True)}))
    reached, depth = found.count(), 0
    while True:
        above = here.filter("kind = 'group'").select("query_id", F.col("node").alias("parent"), F.col("live").alias("__live"))
        here = cut_lineage(nodes.join(above, ["query_id", "parent"]).select(
            *nodes.columns, F.lit(depth + 1).alias("level"), (F.col("__live") & adds).alias("live")))
        more = here.count()
        if not more:
            break
        found, reached, depth = found.unionByName(here), reached + more, depth + 1
    if reached != nodes.count():
        raise ValueError("nodes that no group above leads to")
    return found, depth


def _leaf_id() -> F.Column:
    return F.concat_ws(":", F.col("query_id").cast("string"), F.col("node").cast("string"))


def _climbed(hits: DataFrame, placed: DataFrame, depth: int) -> DataFrame:
    """query_id, doc, score, matched at the roots, from hits of leaves (query_id, node, doc, score, matched)."""
    of = placed.select("query_id", "node", "parent", "occur", "level")
    needed = F.col("occur").isin("must", "filter")
    groups = placed.filter("parent IS NOT NULL").groupBy("query_id", F.col("parent").alias("node")).agg(
        F.sum(needed.cast("int")).alias("n_must"))
    # What a hit needs to know of its parent comes along from the tree, so that a level is one aggregate.
    of = cut_lineage(of.join(groups.withColumnRenamed("node", "parent"), ["query_id", "parent"], "left"))
    hits = cut_lineage(hits.join(of, ["query_id", "node"]))
    good = F.col("occur").isin("must", "should")
    here = hits.filter(F.col("level") == depth)
    for level in range(depth, 0, -1):
        met = here.groupBy("query_id", F.col("parent").alias("node"), "doc").agg(
            F.max("n_must").alias("wanted"), F.sum(needed.cast("int")).alias("must"),
            F.sum((F.col("occur") == "must_not").cast("int")).alias("no"), F.sum((F.col("occur") == "should").cast("int")).alias("may"),
            F.sum(F.when(good, F.col("score")).otherwise(0.0)).alias("score"),
            F.sum(F.when(good, F.col("matched")).otherwise(0)).alias("matched"),
        ).filter("no = 0 AND must = wanted AND (wanted > 0 OR may > 0)").select("query_id", "node", "doc", "score", "matched")
        here = met.join(of, ["query_id", "node"]).select(*hits.columns)
        if level > 1:
            here = here.unionByName(hits.filter(F.col("level") == level - 1))
    return here.select("query_id", "doc", "score", "matched")


def index_of_nodes(nodes: DataFrame, pages: DataFrame, fields: tuple[str, ...], key: str = "url") -> Index:
    """An index of what the leaves name, for :func:`tree_scores` over a page table that has no stored one."""
    return index_of_clauses(nodes.filter("kind <> 'group'").withColumn("clause", _leaf_id()), pages, fields, key)


def tree_scores(nodes: DataFrame, pages: DataFrame, index: Index, key: str = "url", c: float = COORD) -> tuple[DataFrame, DataFrame]:
    """Ranked answers to a table of trees: (query_id, doc, matched, score), and the terms that the queries name.

    The coordination bonus counts the terms of plain leaves, and each other leaf as one, where they add score.
    """
    roots = nodes.filter("parent IS NULL AND kind <> 'group'")
    if roots.limit(1).count():
        raise ValueError("a root must be a group")
    placed, depth = placed_nodes(nodes)
    leaves = cut_lineage(placed.filter("kind <> 'group'").withColumn("clause", _leaf_id()))
    terms = cut_lineage(clause_terms(leaves.select("clause", "field", "kind", "text"), index))
    index = index.lookup(terms.select("field", "term"))
    found = clause_hits(leaves.select("clause", "field", "kind", "text"), terms, index, pages, key)
    hits = found.join(leaves.select("clause", "query_id", "node"), "clause").select("query_id", "node", "doc", "score", "matched")
    live = leaves.filter("live")
    plain = terms.join(live.select("query_id", "clause", "kind"), "clause")
    units = live.filter("kind <> 'term'").select("query_id", "clause", F.lit("").alias("unit")).unionByName(
        plain.filter("kind = 'term'").select("query_id", "clause", "unit")).distinct()
    total = units.groupBy("query_id").agg(F.count("*").alias("total"))
    factor = F.lit(round(1 - c, 9)) + c * F.col("matched") / F.col("total")
    scores = _climbed(hits, placed, depth).join(total, "query_id").select(
        "query_id", "doc", "matched", F.round(F.col("score") * factor, 6).alias("score"))
    return scores, plain.select("query_id", "kind", "clause", "field", "i", "term").distinct()


# ---- query text -----------------------------------------------------------------------------------------------------------

# Operators as words and as signs, and what they make of their two sides.
SIGNS = {"&": "AND", "|": "OR", "&!": "ANDNOT", "&~": "ANDMAYBE"}
ROLES = {"AND": ("must", "must"), "ANDNOT": ("must", "must_not"), "ANDMAYBE": ("must", "should"), "REQUIRE": ("must", "filter")}
# Blanks, brackets, a phrase, a quoted word, an operator sign, a mark before a word, a field, a word. Marks count at a word's start.
PIECE = r'''(?P<blank>\s+)|(?P<open>\()|(?P<close>\))|"(?P<phrase>[^"]*)"?|(?<![^\s(:+-])'(?P<quoted>[^']*)'
    |(?P<sign>&!|&~|&|\|)|(?<![^\s(])(?P<mark>[+-])(?=\S)|(?P<field>%s):(?=[^\s)])|(?P<word>[^\s()"&|]+)'''


@lru_cache(8)
def _pieces(fields: tuple[str, ...]) -> re.Pattern:
    return re.compile(PIECE % "|".join(map(re.escape, fields)), re.VERBOSE)


class _Group:
    """An open bracket: operands and operators so far, what stands before the next operand, and what stands before the bracket."""

    def __init__(self, occur: str | None = None, field: str | None = None, outer: str | None = None):
        self.parts: list = []
        self.occur, self.field, self.before = occur, field, (None, None)
        self.outer = outer

    def take(self) -> tuple[str | None, str]:
        occur, field = self.before
        self.before = (None, None)
        return occur, field or self.outer

    def whole(self):
        """The group as a tree: a leaf, or a list of (occur, tree). OR binds less than the other operators, blanks least."""
        runs, operator = [], None
        for part in self.parts:
            if isinstance(part, str):
                operator = part if runs else None
            elif operator:
                runs[-1] += [operator, part]
                operator = None
            else:
                runs.append([part])
        members = [_joined(run) for run in runs]
        return members[0][1] if len(members) == 1 and members[0][0] != "must_not" else members


def _joined(run: list):
    """One operand, or a chain of operators: (occur, tree)."""
    choices, chain = [], [run[0]]
    for operator, operand in zip(run[1::2], run[2::2]):
        if operator == "OR":
            choices.append(chain)
            chain = [operand]
        else:
            chain += [operator, operand]
    choices.append(chain)
    made = [_chain(c) for c in choices]
    if len(made) == 1:
        occur, tree = made[0]
        return occur or "should", tree
    return "should", [("must_not" if occur == "must_not" else "should", tree) for occur, tree in made]


def _chain(chain: list):
    occur, tree = chain[0]
    grown = False
    for operator, (mark, other) in zip(chain[1::2], chain[2::2]):
        left, right = ROLES[operator]
        right = "must_not" if mark == "must_not" else right
        if grown and operator == "AND":
            tree.append((right, other))
        else:
            tree = [("must_not" if occur == "must_not" and not grown else left, tree), (right, other)]
        occur, grown = None, operator == "AND"
    return occur, tree


def parse(text: str | None, fields: dict[str, str], default: str) -> list[tuple]:
    """Nodes (node, parent, occur, kind, field, text) of a query text; no nodes if there is nothing to look for.

    ``fields`` says of each known field whether it is ``text``, ``exact`` or ``number``; an unknown one is part of the word. Brackets
    that do not match, operators without two sides, marks before nothing and words of nothing but signs are left out.
    """
    stack = [_Group(outer=default)]
    for found in _pieces(tuple(fields)).finditer(text or ""):
        kind, value, top = found.lastgroup, found[found.lastgroup], stack[-1]
        if kind == "word" and value in (*ROLES, "OR"):
            top.parts.append(value)
        elif kind == "sign":
            top.parts.append(SIGNS[value])
        elif kind == "mark" or kind == "word" and value == "NOT":
            top.before = "must" if value == "+" else "must_not", top.before[1]
        elif kind == "field":
            top.before = top.before[0], value
        elif kind == "open":
            occur, field = top.take()
            stack.append(_Group(occur, None, field))
        elif kind == "close" and len(stack) > 1:
            _close(stack)
        elif kind in ("phrase", "quoted", "word"):
            if re.search(r"[\w*?]", value):
                wild = kind == "word" and ("*" in value or "?" in value)
                top.parts.append(_leaf(top, "wildcard" if wild else "phrase" if kind == "phrase" else "term", value, fields))
    while len(stack) > 1:
        _close(stack)
    tree = stack[0].whole()
    if not tree:
        return []
    rows: list[tuple] = []
    _number(rows, tree if isinstance(tree, list) else [("should", tree)], None, "should")
    return rows


def _leaf(top: _Group, kind: str, value: str, fields: dict[str, str]):
    occur, field = top.take()
    how = fields[field]
    return occur, (kind if how == "text" or kind == "wildcard" and how == "exact" else how, field, value)


def _close(stack: list[_Group]) -> None:
    done = stack.pop()
    if tree := done.whole():
        stack[-1].parts.append((done.occur, tree))


def _number(rows: list[tuple], tree, parent: int | None, occur: str) -> None:
    """Numbers nodes from the top; a tree as deep as a text has brackets, so without recursion."""
    todo = [(tree, parent, occur)]
    while todo:
        here, above, role = todo.pop()
        node = len(rows)
        if isinstance(here, list):
            rows.append((node, above, role, "group", None, None))
            todo += [(child, node, o) for o, child in reversed(here)]
        else:
            kind, field, value = here
            rows.append((node, above, role, kind, field, value))


def _field_kinds(pages: DataFrame, key: str) -> dict[str, str]:
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return {name: "exact" if name == key else "text" if kind == "string" else "number" for name, kind in kinds.items()
            if kind in ("string", "tinyint", "smallint", "int", "bigint")}


def parse_queries(queries: DataFrame, fields: dict[str, str], text: str = "q", default: str = "content") -> DataFrame:
    """Trees of a table of query texts (query_id, ``text``). A query with nothing to look for has no nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(query_id, *node) for query_id, q in zip(batch["query_id"], batch["q"])
                    for node in parse(q if isinstance(q, str) else None, fields, default)]
            out = pd.DataFrame(rows, columns=["query_id", "node", "parent", "occur", "kind", "field", "text"])
            yield out.astype({"parent": "Int32"})

    return queries.select("query_id", F.col(text).alias("q")).mapInPandas(run, NODE)


def answerable(nodes: DataFrame) -> DataFrame:
    """query_id of the trees that name something: a word, a number, or more of a word than wildcards."""
    return nodes.filter((F.col("kind") != "group") & F.col("text").rlike(f"[{tx.WORD}]")).select("query_id").distinct()


# ---- whole search -----------------------------------------------------------------------------------------------------------

def _index_of(nodes: DataFrame, pages: DataFrame, key: str, default: str) -> Index:
    named = {(r.field, r.kind) for r in nodes.filter("kind <> 'group'").select("field", "kind").distinct().collect()}
    fields = sorted({f for f, k in named if k != "number"}) or [default]
    if unknown := ({f for f, _ in named} | set(fields)) - set(pages.columns):
        raise ValueError(f"no such fields: {sorted(unknown)}")
    return index_of_nodes(nodes, pages, tuple(fields), key)


def search_trees(nodes: DataFrame, pages: DataFrame, pagenum: int = 1, pagelen: int = PAGE_LEN, key: str = "url",
                 index: Index | None = None, c: float = COORD, default: str = "content") -> tuple[DataFrame, DataFrame]:
    """Trees to result page (query_id, rn, url, title, depth, snippet, score), and the number of hits (query_id, n).

    Snippets show the terms of the leaves in ``default`` that add score; those of a phrase only where all of it stands.
    """
    nodes = cut_lineage(nodes)
    index = index or _index_of(nodes, pages, key, default)
    scores, terms = tree_scores(nodes, pages, index, key, c)
    scores = cut_lineage(scores)
    terms = terms.filter(F.col("field") == default)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "term"))), lambda x: x["term"])
    phrases = terms.filter("kind = 'phrase'").groupBy("query_id", "clause").agg(ordered.alias("words"))
    loose = terms.filter("kind <> 'phrase'").select("query_id", "term").distinct().select("query_id", F.array("term").alias("words"))
    words = phrases.select("query_id", "words").unionByName(loose).groupBy("query_id").agg(F.collect_set("words").alias("terms"))
    hits = search_page(scores.select(*KEYS, "score"), pagenum, pagelen).join(words, "query_id", "left").withColumn(
        "terms", F.coalesce("terms", F.array().cast("array<array<string>>")))
    text_of = pages.withColumnRenamed(key, "doc").select("doc", "title", "depth", "content", "description")
    shown = with_snippet(hits.join(text_of, "doc"), "content", "terms", "snippet", sequences=True).select(
        "query_id", "rn", F.col("doc").alias("url"), "title", "depth",
        snippet_or_fallback(F.col("snippet"), F.col("description"), F.col("content")).alias("snippet"), "score")
    return shown, scores.groupBy("query_id").agg(F.count("*").alias("n"))


def search_text(queries: DataFrame, pages: DataFrame, pagenum: int = 1, pagelen: int = PAGE_LEN, key: str = "url",
                index: Index | None = None, text: str = "q", c: float = COORD, default: str = "content") -> DataFrame:
    """The whole reply to query texts, one row each: valid, results, total, exact, is_last, pagenum and maxpage.

    ``results`` has a struct for each hit of the page, in order; an invalid query has none. Ranked once.
    """
    asked = cut_lineage(queries.select("query_id", text))
    nodes = cut_lineage(parse_queries(asked, _field_kinds(pages, key), text, default))
    valid = answerable(nodes)
    shown, counts = search_trees(nodes.join(valid, "query_id", "left_semi"), pages, pagenum, pagelen, key, index, c, default)
    columns = ("rn", "url", "title", "depth", "snippet", "score")
    results = shown.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("results"))
    checked = asked.select("query_id").join(valid.withColumn("valid", F.lit(True)), "query_id", "left").withColumn(
        "valid", F.coalesce("valid", F.lit(False)))
    kind = shown.select(F.array(F.struct(*columns))).schema[0].dataType
    return page_totals_of(checked, counts, pagenum, pagelen).join(results, "query_id", "left").withColumn(
        "results", F.coalesce("results", F.array().cast(kind)))
