"""SQL for the training-data queries that SQL can express.

The fingerprints, pieces, signatures, indexes and models of the other operators have no SQL;
tests/llm compares them with brute force.
"""

from __future__ import annotations

from litrewise.llm.sharding import Node, uniform_tree

# The numbers are those of litrewise.llm.mixing. A source's sample stops at the rank whose words
# are nearest the rest; rows of equal rank go together, as the default window frame takes them.
SOURCE_MIX = r"""
with numbered_rows as (
    select doc_id, source, text, md5(coalesce(text, '')) as digest,
           row_number() over (partition by doc_id, source, coalesce(text, '')) - 1 as copy
    from documents),
sized as (
    select doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           (('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/' || digest || '/' || copy || '/mix-1'), 1, 13))::bigint::double
               + 0.5) / 4503599627370496.0 as u
    from numbered_rows),
sources as (
    select source, sum(size)::bigint as source_size,
           [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint]::double as weight
    from sized group by source),
caps as (
    select *, 2.0::double * source_size as cap, 2.0::double * source_size / weight as filling,
           sum(source_size) over ()::double * 1.5::double as share
    from sources),
levels as (
    select *, (share - coalesce(sum(cap) over (order by filling, source nulls last
                                               rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (order by filling, source nulls last
                                  rows between current row and unbounded following) as level
    from caps),
final as (
    select min(struct_pack(f := filling, l := level)) filter (where cap > level * weight).l as level from levels),
targets as (
    select source, source_size, least(cap, coalesce(final.level * weight, cap)) as target
    from levels, final),
plans as (
    select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole,
           case when source_size > 0 then target / source_size - floor(target / source_size) else 0 end as fraction
    from targets),
ranked as (
    select s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, p.fraction,
           p.target - p.whole * p.source_size as rest,
           case when fraction > 0 then
               ((u / (1.0::double - u)) / ((size + 1.0::double) / (size + 100.0::double)))
               / (fraction / (1.0::double - fraction)) end as draw
    from sized s join plans p on s.source is not distinct from p.source),
numbered as (
    select *, least(floor(draw / (draw + 1.0::double) * 4503599627370496.0::double)::bigint, 4503599627370495) as place
    from ranked),
summed as (
    select source, place, rest, sum(sum(size)) over (partition by source order by place) as upto, sum(size) as words
    from numbered where fraction > 0 and rest > 0 and size > 0 group by source, place, rest),
crossing as (
    select source, coalesce(min(place) filter (where upto >= rest), max(place)) as place from summed group by source),
cuts as (
    select s.source, case when upto - rest <= rest - (upto - words) then s.place else s.place - 1 end as cut
    from summed s join crossing c on s.source is not distinct from c.source and s.place = c.place)
select doc_id, n.size, source_size::bigint as source_size, target,
       ((whole + case when fraction > 0 and place <= coalesce(cut, -1) then 1 else 0 end) * n.size)::bigint as taken,
       (whole + case when fraction > 0 and place <= coalesce(cut, -1) then 1 else 0 end)::int as copies
from numbered n left join cuts c on n.source is not distinct from c.source
"""



# The checksum of a byte string, bit by bit: a table of 256 remainders, then one step a byte.
CRC_TABLE = """
table_ as (
    select list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t)"""


def _crc32(digits: str) -> str:
    """The unsigned checksum of bytes given in hex; `t` is the column of CRC_TABLE."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
        list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::bigint)),
        lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)))::bigint"""


# Places that equal the one a period further, joined into maximal stretches for each period.
RUNS = f"""
with {CRC_TABLE.strip()},
split as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words,
           case when doc_id is not null then {_crc32("hex(encode(doc_id::varchar))")} end as h
    from documents, table_),
chosen as (
    select *, len(words) as n, (h // 10) % len(words) as a,
           1 + (len(words) - (h // 10) % len(words)) // (3 + (h // 10) % 8) as p
    from split),
texts as (
    select r, doc_id, n, case when h % 10 = 0 and n > 0
        then list_transform(range(n), lambda i: words[case when i < a then i else a + (i - a) % p end + 1])
        else words end as words
    from chosen),
placed as (select r, n, unnest(range(n)) as i, unnest(words) as word from texts),
equal_places as (
    select x.r, y.i - x.i as p, x.i
    from placed x join placed y on x.r = y.r and x.word = y.word and y.i > x.i and y.i - x.i <= x.n // 4),
joined as (select *, i - row_number() over (partition by r, p order by i) as stretch from equal_places),
stretches as (
    select r, p, min(i) as start, count(*) + p as length from joined group by r, p, stretch
    having count(*) + p >= greatest(6, 4 * p)),
runs as (select r, start, length, min(p) as period from stretches group by r, start, length),
listed as (
    select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
    from runs group by r),
best as (
    select * from runs
    qualify row_number() over (partition by r order by length::double / period desc, start, period) = 1),
dropped as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
kept as (
    select r, string_agg(word, ' ' order by i) as collapsed
    from placed anti join dropped using (r, i) group by r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, start::bigint as start, length::bigint as length,
       period::bigint as period, (1000 * length // period)::bigint as exponent_milli,
       sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from texts left join listed using (r) left join best using (r) left join kept using (r)"""


# A base32 character for every five bits: four of them for each five digits of the checksum.
BASE32 = """
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(digest, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::bigint + 1, 1)), '')"""

WARC = f"""
with rested as (
    select row_number() over () as r, page_id, strlen(coalesce(html, ''))::bigint as payload_bytes,
           sha1(coalesce(html, '')) as digest,
           regexp_replace(regexp_replace(coalesce(url, ''), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest,
           url, 1600000000 + coalesce(((page_id % 100000000) + 100000000) % 100000000, 0) as captured
    from pages),
hosts as (
    select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '') as host,
           regexp_replace(rest, '^[^/?]*', '') as path
    from rested),
keyed as (
    select *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')'
              || case when path = '' then '/' else path end as url_key,
           {BASE32} as payload_digest,
           row_number() over (partition by digest order by page_id desc nulls last, url desc nulls last, r) as place,
           max(page_id) over (partition by digest) as largest
    from hosts),
typed as (select *, case when place = 1 then 'response' else 'revisit' end as record_type from keyed)
select page_id, payload_bytes, payload_digest, record_type, case when place > 1 then largest end as refers_to, url_key,
       row_number() over (partition by url_key order by captured, page_id nulls first, payload_digest, record_type) as capture
from typed"""


def _repair_edits(costs: str) -> dict[tuple[int, str], tuple[str, int]]:
    """SQL for the cost of each edit from each state, by the costs `{costs}0..3` that follow it.
    States: nothing given yet, s, a, u last."""
    extra = "case when is_cut then 3 else 0 end"
    following = (3, 3, 3, 2)
    kept = {0: [("s", 1), ("u", 3)], 1: [("u", 3)], 2: [("u", 3)], 3: [("a", 2)]}
    edits = {}
    for q in range(4):
        edits[q, "D"] = (f"4 + {costs}{q}", q)
        keep = " ".join(f"when initial = '{i}' then {costs}{to}" for i, to in kept[q])
        edits[q, "K"] = (f"case when must_go then 1000000000 else (case {keep} else 1000000000 end) + {extra} end", -1)
        edits[q, "R"] = (f"case when must_go then 1000000000 else 3 + {extra} + {costs}{following[q]} end", following[q])
    return edits


def conversations() -> str:
    """Costs from each row to the end by recursion, then the first letter that keeps to them."""
    edits = _repair_edits("n.c")
    least = [f"least({', '.join(edits[q, e][0] for e in 'DKR')})" for q in range(4)]
    walk = _repair_edits("a.c")
    value = "(case state when 0 then b.c0 when 1 then b.c1 when 2 then b.c2 else b.c3 end)"
    chosen = []
    for q in range(4):
        insert = f"3 + b.c{(3, 3, 3, 2)[q]}"
        options = [("D", walk[q, "D"][0]), ("I", insert), ("K", walk[q, "K"][0]), ("R", walk[q, "R"][0])]
        tests = " ".join(f"when {cost} = b.c{q} then '{letter}'" for letter, cost in options)
        chosen.append(f"when {q} then (case {tests} end)")
    return f"""
with recursive {CRC_TABLE.strip()},
named as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as name
    from conversations),
summed as (
    select conv_id, turn, role, text,
           {_crc32("name")} % 20 as fault
    from named, table_),
damaged as (
    select conv_id, turn, case when fault = 4 then 'user' else role end as role,
           case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
           unnest(range(case when fault = 3 then 2 else 1 end)) as copy
    from summed where fault <> 0),
numbered as (
    select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed,
           row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i,
           row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as seen
    from damaged),
flagged as (
    select conv_id, turn, role, text, i, substr(role, 1, 1) as initial, trimmed = '' as is_blank,
           trimmed <> '' and seen as is_duplicate,
           trimmed <> '' and not seen and right(trimmed, 1) not in ('.', '!', '?') as is_cut,
           trimmed = '' or seen as must_go
    from numbered),
lasts as (select conv_id, max(i) as n from flagged group by conv_id),
-- The costs before row i are those of place i; place n + 1 is the end.
costs as (
    select conv_id, n + 1 as i, 0 as c0, 6 as c1, 0 as c2, 3 as c3 from lasts
    union all
    select conv_id, i, least(w0, 3 + e3) as c0, least(w1, 3 + e3) as c1, e2 as c2, e3 as c3
    from (select *, least(w2, 3 + w3) as e2, least(w3, 3 + w2) as e3
          from (select f.conv_id, f.i, {", ".join(f"{c} as w{q}" for q, c in enumerate(least))}
                from costs n join flagged f on f.conv_id is not distinct from n.conv_id and f.i = n.i - 1))),
walk as (
    select conv_id, 1::bigint as i, 0 as state, '' as audit, '' as repaired, 0 as given from lasts
    union all
    select conv_id, case when letter = 'I' then i else i + 1 end,
           case letter when 'D' then state when 'K' then case initial when 's' then 1 when 'u' then 3 else 2 end
                else case when state = 3 then 2 else 3 end end,
           audit || letter,
           case letter when 'D' then repaired
                else repaired || case when given > 0 then chr(10) else '' end
                     || case letter when 'K' then role else case when state = 3 then 'assistant' else 'user' end end
                     || ':' || case letter when 'I' then '' else text end end,
           case letter when 'D' then given else given + 1 end
    from (select w.*, f.initial, f.role, f.text,
                 case when f.i is null then 'I' else case state {" ".join(chosen)} end end as letter
          from walk w
          join lasts l on l.conv_id is not distinct from w.conv_id
          left join flagged f on f.conv_id is not distinct from w.conv_id and f.i = w.i
          left join costs b on b.conv_id is not distinct from w.conv_id and b.i = w.i
          left join costs a on a.conv_id is not distinct from w.conv_id and a.i = w.i + 1
          where w.i <= l.n or (w.i = l.n + 1 and state in (1, 3)))),
repaired as (
    select w.conv_id, w.audit, w.repaired from walk w join lasts l on l.conv_id is not distinct from w.conv_id
    where w.i = l.n + 1 and w.state in (0, 2)),
counted as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
           count(*) filter (where is_blank) as blank, count(*) filter (where is_duplicate) as duplicate,
           count(*) filter (where is_cut) as truncated,
           count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
    from (select *, lag(initial) over (partition by conv_id order by i) as before from flagged) group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
       coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(c.c0, 0)::bigint as cost,
       coalesce(r.audit, '') as audit, sha256(coalesce(r.repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted on counted.conv_id is not distinct from o.conv_id
left join costs c on c.conv_id is not distinct from o.conv_id and c.i = 1
left join repaired r on r.conv_id is not distinct from o.conv_id"""


def _draw(key: str, name: str, weight: float) -> str:
    number = f"('0x' || substr(md5({key} || '/{name}'), 1, 13))::bigint::double"
    return f"-ln(({number} + 0.5) / 4503599627370496.0) / {weight}::double"


def _leaves(level: tuple[Node, ...]) -> list[Node]:
    return [leaf for n in level for leaf in ([n] if n.shard is not None else _leaves(n.children))]


def _shard(key: str, tree: tuple[Node, ...]) -> str:
    """The shard that `key` reaches: the least draw of all is the least at every level above it."""
    draws = [f"struct_pack(d := {_draw(key, n.name, n.weight)}, s := {n.shard})" for n in _leaves(tree)]
    return f"list_min([{', '.join(draws)}]).s"


def sharding(shards: int = 16) -> str:
    """The tree walk in SQL, beside a checksum computed bit by bit."""
    return f"""
with {CRC_TABLE.strip()},
docs as (
    select doc_id, coalesce(doc_id::varchar, '') as key, hex(encode(coalesce(text, ''))) as digits from documents),
summed as (
    select doc_id, key, (length(digits) // 2 + 1)::bigint as size, {_crc32("digits")} as text_crc32
    from docs, table_),
placed as (
    select *, ({_shard("key", uniform_tree(shards))})::int as shard,
           ({_shard("key", uniform_tree(shards + 1))})::int as grown_shard
    from summed)
select doc_id, size, text_crc32, 'key' as law, shard, grown_shard,
       (row_number() over (partition by shard
                           order by ('0x' || substr(md5(concat_ws('/', key, doc_id, size, text_crc32)), 1, 13))::bigint,
                                    doc_id, size, text_crc32) - 1)::bigint as slot
from placed"""


def statements() -> dict[str, str]:
    return {"op5_source_mix": SOURCE_MIX, "op9_sharding": sharding(), "op11_runs": RUNS, "op12_warc": WARC, "op13_conversations": conversations()}
