"""What operators of this subpackage do, as SQL text for another engine: plain forms without
their methods, for small tables."""

from __future__ import annotations

def repeated_strings(size: int = 400, short: int = 300) -> str:
    """Every string of either size by its digest. Texts are hexadecimal, cut into parts, as a
    string's place is found from the start of what it is in."""

    def covered(name: str, n: int) -> str:
        return f"""
        {name}_windows AS (
            SELECT r, b + j AS i, md5(substr(s, 2 * j + 1, {2 * n})) AS k
            FROM (SELECT r, b, substr(h, 2 * b + 1, {2 * (999 + n)}) AS s, unnest(range(0, least(1000, n - {n - 1} - b))) AS j FROM (SELECT r, n, h, unnest(range(0, greatest(n - {n - 1}, 0), 1000)) AS b FROM sized))
        ), {name}_hits AS (
            SELECT r, i FROM {name}_windows WHERE k IN (SELECT k FROM {name}_windows GROUP BY k HAVING count(*) > 1)
        ), {name}_runs AS (
            SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, coalesce((i > lag(i) OVER (PARTITION BY r ORDER BY i) + {n})::INTEGER, 1) AS new FROM {name}_hits)
        ), {name} AS (
            SELECT r, min(i) AS a, max(i) + {n} AS e FROM {name}_runs GROUP BY r, run
        )"""

    return f"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), sized AS (
            SELECT *, length(h) // 2 AS n FROM texts
        ), {covered("spans", size)}, {covered("shared", short)}, kept AS (
            SELECT r, a AS e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS a FROM (SELECT r, a, e FROM spans UNION ALL SELECT r, n, n FROM sized)
        ), joined AS (
            SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (e - a)), '' ORDER BY a) AS h FROM kept JOIN sized USING (r) GROUP BY r
        ), counts AS (
            SELECT r, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r
        ), also AS (
            SELECT r, sum(e - a)::BIGINT AS n_shared FROM shared GROUP BY r
        )
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(joined.h)) AS kept_sha256, coalesce(n_shared, 0) AS n_shared
        FROM sized JOIN joined USING (r) LEFT JOIN counts USING (r) LEFT JOIN also USING (r)
"""


#: The multipliers of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_ALL = 1 << 64


def _c(x: int) -> str:
    return f"{x}::UHUGEINT"


def _times(a: str, p: int) -> str:
    """Modulo 2**64, of 64-bit numbers held in 128 bits."""
    return f"({a} * {_c(p)} % {_c(_ALL)})"


def _plus(a: str, b: str) -> str:
    return f"(({a} + {b}) % {_c(_ALL)})"


def _turned(x: str, r: int) -> str:
    return f"({_times(x, 1 << r)} + {x} // {_c(1 << (64 - r))})"


def _number(x: str, n: int) -> str:
    """Of n bytes in hexadecimal, the least significant first."""
    return "('0x' || " + " || ".join(f"substr({x}, {2 * k + 1}, 2)" for k in range(n - 1, -1, -1)) + ")::UBIGINT::UHUGEINT"


def near_duplicates(seed: int = 42, tau: int = 2) -> str:
    """Fingerprints with XXH64 written out, all pairs compared, and components by reaching."""
    starts = ((seed + _P1 + _P2) % _ALL, (seed + _P2) % _ALL, seed, (seed - _P1) % _ALL)
    stripes = ", ".join(f"list_reduce(list_prepend({_c(v)}, list_transform(range(0, striped // 4), lambda k: t[4 * k + {j}])), lambda a, y: {_times(_turned(_plus('a', 'y'), 31), _P1)}) AS v{j}" for j, v in enumerate(starts, 1))
    summed = " + ".join(_turned(f"v{j}", r) for j, r in ((1, 1), (2, 7), (3, 12), (4, 18)))
    lanes = ", ".join(_times(f"v{j}", _P2) for j in (1, 2, 3, 4))
    lane = f"xor(a, {_times(_turned('y', 31), _P1)})"
    one = _times(_turned(f"xor(a, {_times('y', _P5)})", 11), _P1)
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
    return f"""
        WITH RECURSIVE texts AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT r, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 1, 2) END)) AS i FROM texts)
        ), bytes AS (
            SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingles)
        ), lanes AS (
            SELECT s, n, x, list_transform(range(0, n // 8), lambda k: substr(x, 16 * k + 1, 16)) AS t, n // 32 * 4 AS striped FROM bytes
        ), numbers AS (
            SELECT s, n, x, striped, list_transform(t, lambda y: {_number('y', 8)}) AS t FROM lanes
        ), multiplied AS (
            SELECT s, n, x, striped, list_transform(t, lambda y: {_times('y', _P2)}) AS t FROM numbers
        ), striped AS (
            SELECT s, n, x, striped, t, {stripes} FROM multiplied
        ), folded AS (
            SELECT s, n, x, striped, t, CASE WHEN n < 32 THEN {_c((seed + _P5) % _ALL)} ELSE list_reduce([({summed}) % {_c(_ALL)}, {lanes}],
                lambda a, y: {_plus(_times(lane, _P1), _c(_P4))}) END AS h FROM striped
        ), eights AS (
            SELECT s, n, x, list_reduce(list_prepend({_plus('h', 'n::UHUGEINT')}, t[striped + 1:]), lambda a, y: {_plus(_times(_turned(lane, 27), _P1), _c(_P4))}) AS h, substr(x, n // 8 * 16 + 1) AS rest FROM folded
        ), fours AS (
            SELECT s, n, CASE WHEN n % 8 >= 4 THEN xor(h, {_times(_number('rest', 4), _P1)}) END AS f, h, substr(rest, CASE WHEN n % 8 >= 4 THEN 9 ELSE 1 END) AS rest FROM eights
        ), ones AS (
            SELECT s, list_reduce(list_prepend(CASE WHEN f IS NULL THEN h ELSE {_plus(_times(_turned('f', 23), _P2), _c(_P3))} END, list_transform(range(0, n % 4), lambda k: ('0x' || substr(rest, 2 * k + 1, 2))::UBIGINT::UHUGEINT)), lambda a, y: {one}) AS h FROM fours
        ), mixed AS (
            SELECT s, {_times(f'xor(h, h // {_c(1 << 33)})', _P2)} AS h FROM ones
        ), again AS (
            SELECT s, {_times(f'xor(h, h // {_c(1 << 29)})', _P3)} AS h FROM mixed
        ), hashed AS (
            SELECT s, xor(h, h // {_c(1 << 32)})::UBIGINT AS h FROM again
        ), prints AS (
            SELECT r, ({bits})::UBIGINT AS fp FROM shingles JOIN hashed USING (s) GROUP BY r
        ), every AS (
            SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM texts LEFT JOIN prints USING (r)
        ), points AS (
            SELECT fp, min(doc_id) AS least FROM every GROUP BY fp
        ), links AS (
            SELECT a.fp AS a, b.fp AS b FROM points a JOIN points b ON bit_count(xor(a.fp, b.fp)::HUGEINT) <= {tau}
        ), reach AS (
            SELECT fp AS a, fp AS b FROM points UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), named AS (
            SELECT a AS fp, min(least) AS component_id FROM reach JOIN points ON b = fp GROUP BY a
        )
        SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM every JOIN named USING (fp)
"""


def crc32(x: str) -> str:
    """Of a text, where ``CRC`` is joined."""
    number = f"list_transform(range(0, octet_length(encode({x}))), lambda k: ('0x' || substr(hex(encode({x})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {number}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


#: The 256 steps of crc32, by its polynomial.
CRC = """crc AS (
            SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS steps
        )"""


def resampled(buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    """For features of one word."""
    found = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH {CRC}, texts AS (
            SELECT row_number() OVER () AS r, doc_id, {found} AS w FROM documents
        ), own AS (
            SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM texts) GROUP BY r, word
        ), wanted AS (
            SELECT word, count(*) AS n FROM (SELECT unnest({found}) AS word FROM benchmark) GROUP BY word
        ), hashed AS (
            SELECT word, ({crc32("word")} % {buckets})::BIGINT AS bucket FROM (SELECT word FROM own UNION SELECT word FROM wanted), crc
        ), corpus AS (
            SELECT bucket, sum(n) AS s FROM own JOIN hashed USING (word) GROUP BY bucket
        ), target AS (
            SELECT bucket, sum(n) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket
        ), totals AS (
            SELECT (SELECT coalesce(sum(s), 0) FROM corpus)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS big_t
        ), gains AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + {buckets}) / ((s::DOUBLE + 1) * (big_t + {buckets})))) AS gain FROM corpus LEFT JOIN target USING (bucket), totals
        ), weights AS (
            SELECT r, sum(n) AS n, floor(sum(n * gain) / sum(n)) AS weight FROM own JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r
        ), scores AS (
            SELECT r, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
            FROM texts LEFT JOIN weights USING (r)
        ), places AS (
            SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scores WHERE n_features >= {least_words}
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * able // 100 THEN place END AS rank FROM scores LEFT JOIN places USING (r)
"""


def without_repeated_lines(least: int = 10) -> str:
    return rf"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), each_line AS (
            SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM texts
        ), keyed AS (
            SELECT *, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each_line
        ), shared AS (
            SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= {least} GROUP BY k HAVING count(DISTINCT doc_id) > 1
        )
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(out)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT out), '')) AS kept_sha256
        FROM (SELECT r, doc_id, i, line, coalesce(doc_id > least, false) AS out FROM keyed LEFT JOIN shared USING (k)) GROUP BY r
"""


def repaired() -> str:
    """The cheapest edits by one step for each row: what is least after it for nothing read, a system
    role, a user and an assistant read last."""
    blank = r"[^\x20\x09-\x0D]"
    worst = "{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}"

    def edit(state: str, cost: str, letter: str, row: str | None = None) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {f'list_append({state}.t, {row})' if row else state + '.t'}}}"

    def least(*moves: str) -> str:
        return f"list_sort([{', '.join(moves)}])[1]"

    def when(test: str, move: str) -> str:
        return f"CASE WHEN {test} THEN {move} ELSE {worst} END"

    def read(initial: str, role: str, befores: list[str]) -> list[str]:
        keep = [when(f"NOT gone AND initial = '{initial}'", edit(b, "cut", "K", "role || ':' || text")) for b in befores]
        rename = [when("NOT gone", edit(b, "cut + 1", "R", f"'{role}:' || text")) for b in befores] if role else []
        return keep + rename

    return f"""
        WITH RECURSIVE {CRC}, hurt AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations, crc
        ), copies AS (
            SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM (SELECT *, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) FROM hurt WHERE code > 0)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM copies
        ), told AS (
            SELECT *, substr(role, 1, 1) AS initial, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS follows,
                CASE WHEN NOT regexp_matches(text, '{blank}') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN regexp_extract(text, '({blank})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
            FROM placed
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
                count_if(follows IS NOT NULL AND initial || follows NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
            FROM told GROUP BY conv_id
        ), steps AS (
            SELECT conv_id, i, role, text, initial, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cut FROM told
        ), parsed AS (
            SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS e, {worst} AS s, {{'c': 5, 'a': 'I', 't': ['user:']}} AS u, {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}} AS x FROM counts
            UNION ALL
            SELECT conv_id, i, e, s, u, {least("x", edit("u", "5", "I", "'assistant:'"))} AS x
            FROM (
                SELECT conv_id, i, e, s, {least("u", *(edit(b, "5", "I", "'user:'") for b in ("e", "s", "x")))} AS u, x
                FROM (
                    SELECT conv_id, steps.i, {edit("e", "2", "D")} AS e, {least(edit("s", "2", "D"), *read("s", "", ["e"]))} AS s,
                        {least(edit("u", "2", "D"), *read("u", "user", ["e", "s", "x"]))} AS u, {least(edit("x", "2", "D"), *read("a", "assistant", ["u"]))} AS x
                    FROM parsed JOIN steps USING (conv_id) WHERE steps.i = parsed.i + 1
                )
            )
        ), ends AS (
            SELECT conv_id, {least("e", "x")} AS b FROM parsed JOIN counts USING (conv_id) WHERE i = n
        )
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
            coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN ends USING (conv_id)
"""
