"""DuckDB twins of the queries that SQL can express, by their definitions."""

from __future__ import annotations

from demandlens.llm import licenses, mixing

WORDS = r"'[^\x20\x09-\x0D]+'"


def mixing_ctes(documents: str) -> str:
    """CTEs that end in ``mixed``: all columns of ``documents`` and the mix."""
    w1, w2, w3 = mixing.WEIGHTS
    return f"""
m_rows AS (select d.*, source as src, coalesce(cast(doc_id as varchar), '') as key,
                  coalesce(len(regexp_extract_all(text, {WORDS})), 0)::bigint as size from {documents} d),
m_docs AS (select *, (size * {mixing.SCALE}) // (size + {mixing.HALF_LENGTH}) as x,
                  (('0x' || substr(md5(key || ':{mixing.SEED}'), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
           from m_rows),
m_src AS (select src, sum(size)::bigint as source_size, sum(size * x)::bigint as sx,
                 case (row_number() over (order by src nulls last) - 1) % 3
                      when 0 then {w1}::double when 1 then {w2}::double else {w3}::double end as w
          from m_docs group by src),
m_most AS (select *, source_size * {mixing.CAP}::double as most, sum(source_size) over () * {mixing.SHARE}::double as total,
                  row_number() over (order by source_size * {mixing.CAP}::double / w, src nulls last) as pos from m_src),
m_level AS (select *, (total - coalesce(sum(most) over (order by pos rows between unbounded preceding and 1 preceding), 0.0::double))
                  / sum(w) over (order by pos rows between current row and unbounded following) as level from m_most),
m_open AS (select *, min(case when w * level < most then pos end) over () as first_open from m_level),
m_target AS (select src, source_size, sx, case when pos < coalesce(first_open, 1 << 30) then most else
                  w * max(case when pos = first_open then level end) over () end as target from m_open),
m_m AS (select d.*, t.source_size, t.target, case when d.size > 0 then
               t.target / t.source_size + {mixing.TILT}::double * least(t.target / t.source_size, {mixing.CAP}::double - t.target / t.source_size)
               * (d.x - t.sx::double / t.source_size) / {mixing.SCALE}::double else 0.0::double end as m
        from m_docs d join m_target t on d.src is not distinct from t.src),
m_p AS (select *, floor(m)::bigint as c, m - floor(m) as p from m_m),
m_v AS (select *, case when p > 0 then u * (1 - p) / (u * (1 - p) + (1 - u) * p) end as v from m_p),
m_rest AS (select src, any_value(target) - sum(c * size)::bigint as rest from m_v group by src),
m_keys AS (select src, v, key, sum(size)::bigint as words from m_v where p > 0 group by src, v, key),
m_run AS (select *, sum(words) over (partition by src order by v, key) - words as before from m_keys),
m_take AS (select k.src, k.v, k.key, k.before + k.words / 2 <= r.rest as more
           from m_run k join m_rest r on k.src is not distinct from r.src),
mixed AS (select a.*, (a.c + coalesce(b.more, false)::int)::bigint as copies,
                 ((a.c + coalesce(b.more, false)::int) * a.size)::bigint as taken
          from m_v a left join m_take b on a.src is not distinct from b.src and a.v = b.v and a.key = b.key)"""


ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_cte(name: str, source: str, key: str) -> str:
    """CTE ``name`` ({key}, s): distinct 5-word shingles, by row of ``source``."""
    return f"""
{name}_w AS (select *, regexp_extract_all({ASCII_LOWER}, {WORDS}) as w, row_number() over () as row_no from {source}),
{name} AS (select distinct row_no, {key}, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)),
                  lambda i: array_to_string(w[i:i + 4], ' '))) as s from {name}_w where len(w) > 0)"""


def matches_ctes(documents: str, benchmark: str = "benchmark") -> str:
    """CTEs that end in ``hits``: (row_no, doc_id, item row, item_id, n_item, n_shared)."""
    return shingle_cte("d_sh", documents, "doc_id") + "," + shingle_cte("i_sh", benchmark, "item_id") + """,
i_n AS (select row_no, count(*) as n_item from i_sh group by row_no),
both_ AS (select d.row_no as d_row, d.doc_id, i.row_no as i_row, i.item_id, count(*) as n_shared
          from d_sh d join i_sh i on d.s = i.s group by all),
hits AS (select d_row, doc_id, item_id, n_item, n_shared from both_ join i_n on i_row = i_n.row_no
         where 100 * n_shared >= 75 * n_item)"""


def crc32(text: str) -> str:
    """crc32 of an ASCII string, bit by bit."""
    bit = "lambda v, z: xor(v >> 1, (v & 1) * 3988292384)"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), {byte}), 4294967295)"


def _record(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"


def _merkle_levels(name: str, key: str, levels: int) -> str:
    """CTEs {name}1.. (nodes by level), {name}0x.. (siblings) and {name}top of {name}0 ({key}, n, pos, digest)."""
    out = []
    for i in range(levels):
        run = f"partition by {key}, pos // 16 order by pos rows between"
        out.append(f"""{name}{i}x AS (select {key}, pos,
            coalesce(string_agg(digest, '') over ({run} unbounded preceding and 1 preceding), '') as lft,
            coalesce(string_agg(digest, '') over ({run} 1 following and unbounded following), '') as rgt
            from {name}{i} where n > 1)""")
        out.append(f"""{name}{i + 1} AS (select {key}, (n + 15) // 16 as n, pos // 16 as pos, sha256(string_agg(digest, '' order by pos)) as digest
            from {name}{i} where n > 1 group by {key}, n, pos // 16)""")
    tops = " union all ".join(f"select {key}, digest from {name}{i} where n = 1" for i in range(levels + 1))
    return ",\n".join(out) + f",\n{name}top AS ({tops})"


def _merkle_walk(name: str, tree: str, key: str, pos: str, levels: int) -> str:
    """CTEs {name}1..: the proof so far and the folded digest of every leaf of {name}0."""
    out = []
    for i in range(levels):
        out.append(f"""{name}{i + 1} AS (select w.* replace (w.proof || coalesce(x.lft || x.rgt, '') as proof,
            case when x.pos is null then w.cur else sha256(x.lft || w.cur || x.rgt) end as cur)
            from {name}{i} w left join {tree}{i}x x on w.{key} = x.{key} and w.{pos} // {16 ** i} = x.pos)""")
    return ",\n".join(out)


def manifest_sql(levels: int = 6, top_levels: int = 4) -> str:
    fields = "doc_id source lang n_chars text".split()
    record = " || ".join(_record(f) for f in fields)
    lowered = " || ".join(_record(ASCII_LOWER if f == "text" else f) for f in fields)
    return f"""with m_leaf AS (select doc_id, coalesce('=' || source, '') as k, sha256({record}) as leaf,
        case when {crc32('doc_id::varchar')} % 5 = 0 then sha256({lowered}) else sha256({record}) end as other from documents),
b AS (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by k) as n from m_leaf),
s0 AS (select k, n, pos, leaf as digest from b),
{_merkle_levels('s', 'k', levels)},
t0k AS (select k, row_number() over (order by k) - 1 as pos, count(*) over () as n, digest from stop),
t0 AS (select 0 as g, n, pos, digest from t0k),
{_merkle_levels('t', 'g', top_levels)},
v0 AS (select doc_id, leaf, k, 0 as g, pos, leaf as untouched, other as cur, '' as proof from b),
{_merkle_walk('v', 's', 'k', 'pos', levels)},
u0 AS (select v.*, t.pos as tpos, t.digest as subroot from v{levels} v join t0k t on v.k = t.k),
{_merkle_walk('u', 't', 'g', 'tpos', top_levels)}
select doc_id, leaf, subroot, r.digest as root, sha256(proof) as proof_sha256, cur as folded_root, cur = r.digest as verified
from u{top_levels} u join ttop r on u.g = r.g"""


def _walk(base: str, letter: str, cost: str, piece: str | None) -> str:
    out = f"{base}.o" if piece is None else f"list_append({base}.o, {piece})"
    return f"{{'c': {base}.c + {cost}, 'a': {base}.a || '{letter}', 'o': {out}}}"


def _least(*walks: str) -> str:
    return f"list_sort([{', '.join(walks)}])[1]"


def repair_sql() -> str:
    """The repair as a recursion over rows: the least walk to each of the four
    states (q0 nothing, q1 system, q2 user, q3 assistant) after every row."""
    none = "{'c': 1000000000::bigint, 'a': '', 'o': []::varchar[]}"
    text = "coalesce(text, ' ')"
    stripped = "rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    ins2 = [_walk(f"s.q{q}", "I", "2", "'user:'") for q in (0, 1, 3)]
    said, extra = "r.role || ':' || r.text", "r.extra"
    gone = {q: _walk(f"t.q{q}", "D", "3", None) for q in range(4)}
    rerole2 = [_walk(f"t.q{q}", "R", f"2 + {extra}", "'user:' || r.text") for q in (0, 1, 3)]
    rerole3 = _walk("t.q2", "R", f"2 + {extra}", "'assistant:' || r.text")
    keep = {(q, to): _walk(f"t.q{q}", "K", extra, said) for q, to in ((0, 1), (0, 2), (1, 2), (3, 2), (2, 3))}

    def edge(walk: str, when: str) -> str:
        return f"case when not r.drop_ and {when} then {walk} else {none} end"

    q1 = _least(gone[1], edge(keep[0, 1], "r.initial = 's'"))
    q2 = _least(gone[2], *[edge(keep[q, 2], "r.initial = 'u'") for q in (0, 1, 3)], *[edge(w, "true") for w in rerole2])
    q3 = _least(gone[3], edge(keep[2, 3], "r.initial = 'a'"), edge(rerole3, "true"))
    return f"""with recursive h as (select conv_id, turn, coalesce(role, ' ') as role, {text} as text,
        {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations),
d as (select coalesce('=' || conv_id, '') as k, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when kind = 3 then [0, 1] else [0] end) as copy from h where kind <> 0),
p as (select *, row_number() over (partition by k order by turn nulls first, role, text, copy) as pos, left(role, 1) as initial,
        {stripped} as bare from d),
f as (select *, row_number() over (partition by k, role, text order by pos) as seen, lead(initial) over (partition by k order by pos) as nxt from p),
g as (select *, case when bare = '' then 'blank' when seen > 1 then 'duplicate'
        when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from f),
r as materialized (select k, pos, role, text, initial, fault in ('blank', 'duplicate') as drop_, case when fault = 'truncated' then 1 else 0 end as extra from g),
counts as (select k, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
        count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (nxt is not null and initial || nxt not in ('su', 'ua', 'au')) as illegal from g group by k),
walk as (
    select k, 0::bigint as done, {none.replace('1000000000', '0')} as q0, {none} as q1, {none} as q2, {none} as q3 from counts
    union all
    select t.k, t.done + 1, {gone[0]}, {q1}, {q2}, {q3}
    from (select s.k, s.done, s.q0, s.q1, {_least("s.q2", *ins2)} as q2,
                 {_least("s.q3", _walk(_least("s.q2", *ins2), "I", "2", "'assistant:'"))} as q3 from walk s) t
    join r on t.k = r.k and r.pos = t.done + 1),
e as (select s.k, {_least("s.q0", "s.q3", _walk(_least("s.q2", *ins2), "I", "2", "'assistant:'"))} as best
      from walk s join counts n on s.k = n.k and s.done = n.n),
ids as (select distinct conv_id, coalesce('=' || conv_id, '') as k from conversations)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost,
       coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) as repaired_sha256
from ids left join counts using (k) left join e using (k)"""


def licences_sql() -> str:
    """The licence scan over all words of all texts, one row a word."""
    def values(rows, cols):
        return "(values " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + f") t({cols})"

    def starts(phrase):
        parts = phrase.split()
        cond = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        return f"list_filter(generate_series(1, len(w) - {len(parts) - 1}), lambda i: {cond})"

    postings, keys = [], []
    for t, (label, text, phrases) in enumerate(licenses.TEMPLATES):
        parts = text.split()
        postings += [(t, label, q, w) for q, w in enumerate(parts)]
        for p in phrases:
            run = p.split()
            keys += [(t, q, p) for q in range(len(parts)) if parts[q:q + len(run)] == run]
    base = " union all ".join(f"select row_no, '{label}' as label, unnest({starts(p)}) - 1 as at_ from d" for p, label in licenses.BASE)
    found = " union all ".join(f"select row_no, '{p}' as phrase, unnest({starts(p)}) - 1 as at_ from d" for p in licenses.PHRASES)
    key_words = [(t, w) for t, (_, _, phrases) in enumerate(licenses.TEMPLATES) for p in phrases for w in p.split()]
    return rf"""with d as materialized (select doc_id, row_number() over () as row_no,
        coalesce(regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
postings as (select * from {values(postings, 'template, label, place, word')}),
key_at as (select * from {values(keys, 'template, place, phrase')}),
key_word as (select * from {values(key_words, 'template, word')}),
hits as materialized (select * from (select row_no, unnest(w) as word, unnest(generate_series(0, len(w) - 1)) as at_ from d) x
        where word in (select word from postings)),
counted as (select word, count(distinct row_no) as files from hits group by word),
weights as (select v.word, case when x = 0 then 1 else 1 + len(bin(x)) end as weight
        from (select word, (select count(*) from d) // (coalesce(files, 0) + 1) as x
              from (select distinct word from postings) p left join counted using (word)) v),
least as (select min(top) as weight from (select template, max(weight) as top from key_word join weights using (word) group by template) k),
probes as (select w.* from weights w, least l where w.weight >= l.weight),
index_ as (select template, label, place, word, weight, sum(weight) over (partition by template) as total from postings join probes using (word)),
votes as (select row_no, template, label, at_ - place as shift, total, sum(weight) as got from hits join index_ using (word) group by all),
found as ({found}),
due as (select row_no, template, phrase, at_ - place as due from found join key_at using (phrase)),
held as (select row_no, template, label, shift, got, total, count(distinct phrase) as stands from votes join due using (row_no, template)
        where 2 * got >= total and abs(shift - due) <= {licenses.SLACK} group by all),
verified as (select row_no, label, got / total as share from held
        join (select template, count(distinct phrase) as n from key_at group by template) k using (template) where stands = n),
base as ({base}),
b as (select row_no, count(*) as n_base, min(at_) as first_word, max(at_) as last_word,
        string_agg(distinct label, ',' order by label) as base_labels from base group by row_no),
l as (select row_no, string_agg(distinct label, ',' order by label) as labels
        from (select row_no, label from base union all select row_no, label from verified) u group by row_no),
s as (select row_no, max(share) as score from verified group by row_no)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join b using (row_no) left join l using (row_no) left join s using (row_no)"""


ORACLE = {
    "op11_licenses": licences_sql(),
    "op13_repair": repair_sql(),
    "op12_manifest": manifest_sql(),
    "op3_decontaminate": f"with {matches_ctes('documents')} select doc_id, item_id, n_item as n_item_shingles, "
                         "n_shared, n_shared / n_item as containment from hits",
    "op5_mixing": f"with {mixing_ctes('documents')} "
                  "select doc_id, size, source_size, target, taken, copies from mixed",
}
