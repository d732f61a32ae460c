"""``licenses.scan`` as DuckDB SQL over ``documents``, made from the same index."""

from __future__ import annotations

from millrace.llm.licenses import BASE, LOWER, UPPER, LicenseIndex


def values(rows: list[tuple]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    return "VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def license_sql(index: LicenseIndex) -> str:
    postings = index.postings()
    about = [(k, t.label, min(index.look_up, len({w for _, w in index.rare(t)})), (1 << len(t.phrases)) - 1) for k, t in enumerate(index.templates)]
    phrases = [(p, p.split()[0], len(p.split())) for p in sorted({*index.phrases(), *BASE})]
    return f"""
        WITH texts AS (
            SELECT row_number() OVER () AS rid, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        placed AS (SELECT rid, w, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts),
        vocabulary(word) AS ({values([(w,) for w in index.vocabulary()])}),
        phrases(phrase, start, n) AS ({values(phrases)}),
        base(phrase, label) AS ({values(list(BASE.items()))}),
        postings(token, template, place, word_bit, phrase_bit) AS ({values(postings)}),
        about(template, label, most, needed) AS ({values(about)}),
        seen AS (SELECT word, count(DISTINCT rid) AS n FROM placed SEMI JOIN vocabulary USING (word) GROUP BY word),
        rare AS (
            SELECT template, token FROM (SELECT DISTINCT template, token FROM postings WHERE word_bit > 0) LEFT JOIN seen ON word = token
            QUALIFY row_number() OVER (PARTITION BY template ORDER BY coalesce(n, 0), token) <= {index.look_up}),
        indexed AS (
            SELECT * FROM postings SEMI JOIN rare USING (template, token) WHERE word_bit > 0
            UNION ALL SELECT * FROM postings WHERE phrase_bit > 0),
        found AS (
            SELECT rid, i, phrase FROM placed JOIN phrases ON word = start
            WHERE array_to_string(w[i + 1 : i + n], ' ') = phrase),
        tokens AS (
            SELECT rid, i, word AS token FROM placed SEMI JOIN vocabulary USING (word)
            UNION ALL SELECT rid, i, phrase FROM found),
        aligned AS (
            SELECT rid, template, i - place AS begins, bit_or(word_bit) AS words, bit_or(phrase_bit) AS keys
            FROM tokens JOIN indexed USING (token) GROUP BY ALL),
        added AS (
            SELECT rid, label, least(1.0::DOUBLE, bit_count(words)::DOUBLE / most) AS share
            FROM aligned JOIN about USING (template) WHERE keys = needed),
        method AS (SELECT rid, list(label) AS labels, max(share) AS score FROM added WHERE share >= {index.least} GROUP BY rid),
        counted AS (
            SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(label) AS labels
            FROM found JOIN base USING (phrase) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
            CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
            array_to_string(list_sort(list_distinct(coalesce(counted.labels, []))), ',') AS base_labels,
            array_to_string(list_sort(list_distinct(list_concat(coalesce(counted.labels, []), coalesce(method.labels, [])))), ',') AS labels,
            CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM texts LEFT JOIN counted USING (rid) LEFT JOIN method USING (rid)
    """
