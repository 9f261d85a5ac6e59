"""DuckDB SQL of the corpus queries that SQL can express, straight from their contracts (ids are unique in the tables)."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SOLID = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""with d as (select doc_id, {_ALNUM} as w from documents),
    i as (select item_id, w, least(10, len(w)) as n from (select item_id, {_ALNUM} as w from benchmark) where len(w) > 0),
    iw as (select distinct item_id, n, array_to_string(w[k : k + n - 1], ' ') as s from (select *, unnest(range(1, len(w) - n + 2)) as k from i)),
    dw as (select doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from i))),
    hits as (select doc_id, k, n, item_id from dw join iw using (n, s)),
    words as (select doc_id, count(*) as n_hit from (select distinct doc_id, k + j as at from (select *, unnest(range(n)) as j from (select distinct doc_id, k, n from hits))) group by doc_id),
    items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join words using (doc_id) left join items using (doc_id)"""

JACCARD = f"""with recursive d as (select doc_id, {_SOLID} as w from documents),
    sh as (select distinct doc_id, array_to_string(w[k : k + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from d where len(w) > 0)),
    n as (select doc_id, count(*) as n from sh group by doc_id),
    shared as (select a.doc_id as x, b.doc_id as y, count(*) as m from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
    links as (select x, y from shared join n a on x = a.doc_id join n b on y = b.doc_id where 100 * m >= 80 * (a.n + b.n - m)),
    ends as (select x as a, y as b from links union all select y, x from links),
    reach as (select doc_id, doc_id as other from d union select doc_id, b from reach join ends on other = a)
    select doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id from reach left join n using (doc_id) group by doc_id"""


def _spans(length: int) -> str:
    """Maximal runs of bytes that strings of ``length`` bytes with a second start cover, over ``b`` (doc_id, h: hex, n)."""
    return f"""(select doc_id, min(i) as lo, max(i) + {length} as hi from (select *, sum(fresh) over (partition by doc_id order by i) as run from
    (select *, (i > coalesce(lag(i) over (partition by doc_id order by i) + {length}, -1))::int as fresh from
    (select doc_id, i, count(*) over (partition by key) as starts from (select doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * length})) as key from (select *, unnest(range(n - {length - 1})) as i from b))) where starts > 1)) group by doc_id, run)"""


SUFFIX = f"""with b as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
    gone as {_spans(400)}, passages as (select doc_id, sum(hi - lo) as passage_bytes from {_spans(250)} group by doc_id),
    edges as (select doc_id, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as since, lo from gone union all select doc_id, coalesce(last, 0), n from b left join (select doc_id, max(hi) as last from gone group by doc_id) using (doc_id)),
    kept as (select doc_id, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' order by since) as k from edges join b using (doc_id) group by doc_id),
    counts as (select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans from gone group by doc_id)
    select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(k)) as kept_sha256, coalesce(passage_bytes, 0)::bigint as passage_bytes
    from b join kept using (doc_id) left join counts using (doc_id) left join passages using (doc_id)"""

def _crc32(hex_digits: str) -> str:
    """Unsigned CRC-32 of bytes given as hex, with ``crc`` (one row, t: its table of 256 remainders)."""
    octets = f"list_transform(range(0, length({hex_digits}) // 2), lambda i: ('0x' || substr({hex_digits}, 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295::bigint)"


_CRC_TABLE = "crc as (select list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end)) as t)"


def _merkle(levels: int = 8) -> str:
    """Level by level: a node's digest, place, siblings to its left and right; enough levels for 16^8 rows of a source."""
    part = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        _CRC_TABLE,
        f"d as (select doc_id, coalesce('1' || source, '0') as g, {leaf('text')} as leaf, case when {_crc32('hex(encode(doc_id::varchar))')} % 5 = 0 then {leaf(lower)} else {leaf('text')} end as t from documents, crc)",
        "a0 as (select g, row_number() over (partition by g order by doc_id) - 1 as i, leaf as h, count(*) over (partition by g) as n from d)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            w = "partition by g, i // 16 order by i rows between unbounded preceding and"
            steps.append(f"{name}s{k} as (select g, i, h, n, coalesce(string_agg(h, '') over ({w} 1 preceding), '') as l, coalesce(string_agg(h, '') over (partition by g, i // 16 order by i rows between 1 following and unbounded following), '') as r from {name}{k})")
            steps.append(f"{name}{k + 1} as (select g, i // 16 as i, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h, (any_value(n) + 15) // 16 as n from {name}{k} group by g, i // 16)")

    climb("a")
    steps.append(f"b0 as (select '' as g, row_number() over (order by g) - 1 as i, h, count(*) over () as n, g as own from a{levels})")
    climb("b")
    joins = "".join(f" join as{k} on as{k}.g = x.g and as{k}.i = x.i // {16**k}" for k in range(levels))
    joins += " join b0 on b0.own = x.g" + "".join(f" join bs{k} on bs{k}.i = b0.i // {16**k}" for k in range(levels)) + f" cross join b{levels} z"
    proof = " || ".join([f"as{k}.l || as{k}.r" for k in range(levels)] + [f"bs{k}.l || bs{k}.r" for k in range(levels)])
    sides = ", ".join(f"[{p}s{k}.l, {p}s{k}.r, (case when {p}s{k}.n = 1 then '' else 'x' end)]" for p in "ab" for k in range(levels))
    steps.append("x as (select d.*, row_number() over (partition by g order by doc_id) - 1 as i from d)")
    steps.append(
        f"y as (select doc_id, leaf, b0.h as subroot, z.h as root, sha256({proof}) as proof_sha256, list_reduce(list_prepend([t, '', ''], [{sides}]), lambda p, q: [case when q[3] = '' then p[1] else sha256(q[1] || p[1] || q[2]) end, '', ''])[1] as folded_root from x{joins})"
    )
    return "with " + ", ".join(steps) + " select *, folded_root = root as verified from y"


SPELLING = f"""with recursive {_CRC_TABLE},
    runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
    hashed as (select *, {_crc32("x")} as h from (select doc_id, run, count(*) as c, hex(encode(doc_id::varchar || ':' || run)) as x from runs where length(run) >= 5 group by all), crc),
    words as (select word, sum(c)::bigint as n from (select c, case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed) where length(word) >= 5 group by word having sum(c) >= 3),
    less as (select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word)))::int as i from words)),
    pairs as (select a.word as a, b.word as b from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
        union select l.word, w.word from less l join words w on l.rest = w.word union select w.word, l.word from less l join words w on l.rest = w.word),
    near as (select a as word, count(*) as n_near, arg_min(b, (-n, b)) as best, max(n) as best_n from pairs join words on b = word group by a),
    forms as (select words.word, n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * n then best end as form, case when best_n >= 2 * n then best_n end as form_n from words left join near using (word)),
    way as (select word, form as stop from forms where form is not null union all select way.word, f.form from way join forms f on f.word = way.stop where f.form is not null),
    ends as (select way.word, way.stop from way join forms f on f.word = way.stop where f.form is null)
    select word, form, coalesce(stop, word) as root, n, n_near, form_n from forms left join ends using (word)"""

ORACLES = {"op11_merkle_manifest": _merkle(), "op12_spelling_variants": SPELLING, "op7_decontamination": DECONTAMINATION, "op8_jaccard_join": JACCARD, "op9_suffix_dedup": SUFFIX}
