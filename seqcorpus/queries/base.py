"""Registry of queries and the views that their SQL starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: base of the to-and-fro length key; no limit of anything
KEY_LENGTH = 600
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")

# view -> (views it needs, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "lines": ([], """
        SELECT doc_id, line_no, line FROM (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
        WHERE trim(line) <> ''"""),
    "tokens0": (["lines"], """
        SELECT doc_id, line_no, unnest(t) AS surface, unnest(range(1, len(t) + 1)) AS tok_no FROM (
          SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS t FROM lines)"""),
    "tokens": (["tokens0"], """
        SELECT *, length(surface) AS n,
          coalesce(sum(length(surface)) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_idx,
          CASE WHEN regexp_matches(surface, '^[0-9]+$') THEN 'num'
               WHEN regexp_matches(surface, '^[A-Za-z]+$') THEN 'word' ELSE 'mixed' END AS pos,
          CASE WHEN regexp_matches(surface, '[.,;:!?]$') THEN 'punct' ELSE 'plain' END AS subpos,
          CASE WHEN regexp_matches(surface, '^[A-Z]') THEN 'cap' ELSE 'low' END AS ctype,
          CASE WHEN length(surface) < 4 THEN 'short' WHEN length(surface) < 8 THEN 'mid' ELSE 'long' END AS cform
        FROM tokens0"""),
    "nodes": (["tokens"], """
        SELECT *, 2 * tok_no - 1 AS node_id, CASE WHEN tok_no = 1 THEN 0 ELSE 2 * tok_no - 3 END AS prev_id,
               1 AS node_rank, pos = 'mixed' AS unk FROM tokens
        UNION ALL
        SELECT * REPLACE ('alt' AS pos), 2 * tok_no, CASE WHEN tok_no = 1 THEN 0 ELSE 2 * tok_no - 3 END,
               2, false FROM tokens WHERE n >= 6"""),
    "chars": (["tokens"], """
        SELECT * EXCLUDE (p), start_idx + p AS cp, substr(surface, p + 1, 1) AS ch,
               CASE WHEN p = 0 THEN 1 WHEN p = n - 1 THEN 3 ELSE 2 END AS seg
        FROM (SELECT *, unnest(range(n)) AS p FROM tokens)"""),
    "counts": (["chars", "nodes"], """
        SELECT 'cpt' AS kind, ch AS value, count(*) AS cnt FROM chars GROUP BY ch
        UNION ALL SELECT 'pos', pos, count(*) FROM nodes GROUP BY pos
        UNION ALL SELECT 'subpos', subpos, count(*) FROM nodes GROUP BY subpos
        UNION ALL SELECT 'conjtype', ctype, count(*) FROM nodes GROUP BY ctype
        UNION ALL SELECT 'conjform', cform, count(*) FROM nodes GROUP BY cform"""),
    "charset": (["counts"], """
        SELECT ch, max(cnt) AS cnt FROM (
          SELECT value AS ch, cnt FROM counts WHERE kind = 'cpt'
          UNION ALL SELECT chr(i::INT), 0 FROM range(33, 128) t(i)) GROUP BY ch"""),
    "chardict": (["charset"], """
        SELECT ch, cnt, 3 + row_number() OVER (ORDER BY ch) AS id FROM charset"""),
    "benchdict": ([], """
        SELECT ch, max(cnt) AS cnt, 3 + row_number() OVER (ORDER BY ch) AS id FROM (
          SELECT ch, count(*) AS cnt FROM (
            SELECT unnest(string_split(replace(replace(text, chr(10), ''), ' ', ''), '')) AS ch FROM benchmark)
          WHERE ch <> '' GROUP BY ch UNION ALL SELECT chr(i::INT), 0 FROM range(33, 128) t(i)) GROUP BY ch"""),
    "tagdict": (["counts"], """
        SELECT CASE kind WHEN 'conjtype' THEN 'ctype' WHEN 'conjform' THEN 'cform' ELSE kind END AS kind,
               value AS tag, cnt, row_number() OVER (PARTITION BY kind ORDER BY cnt DESC, value) AS id
        FROM counts WHERE kind <> 'cpt'"""),
    "coded": (["chars", "chardict"], """
        SELECT doc_id, line_no, count(*) AS n, [2] || list(coalesce(d.id, 1) ORDER BY cp) || [3] AS codes
        FROM chars LEFT JOIN chardict d USING (ch) GROUP BY doc_id, line_no"""),
    "goldpred": (["chars"], """
        SELECT doc_id, line_no, cp + 1 AS pos_no, seg AS gold,
               CASE WHEN (doc_id * 31 + line_no * 17 + (cp + 1) * 7) % 13 <> 0 THEN seg
                    WHEN seg = 1 THEN 2 ELSE 1 END AS pred FROM chars"""),
}


def with_views(*names: str) -> str:
    """``WITH`` clause of the named views and all that they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``views`` are put in front of its SQL."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            if views:
                text = with_views(*views).rstrip() + (",\n" + text[5:] if text.startswith("WITH ") else "\n" + text)
            ORACLES[name] = text
        return fn

    return add


def sql_unit(parts: str, salt: str, word: int = 0, seed: int = 1) -> str:
    """SQL of ``hashing.uniform``; ``parts`` are SQL expressions joined by commas."""
    key = f"md5(concat_ws(':', '{seed}', {parts}, '{salt}'))"
    return f"(('0x' || substr({key}, {1 + 8 * word}, 8))::BIGINT / 4294967296.0::DOUBLE)"
