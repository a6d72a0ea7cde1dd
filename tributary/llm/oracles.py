"""The SQL twins of the queries, for DuckDB over the same tables."""

OP3_SQL = r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
    from documents
), shingles as (
    select distinct doc_id, case when len(w) = 1 then w[1] else unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
    from words where len(w) > 1
    union select doc_id, w[1] from words where len(w) = 1
), sizes as (
    select doc_id, count(s) as n from words left join shingles using (doc_id) group by doc_id
), links as (
    select x.doc_id as a, y.doc_id as b
    from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id
    join sizes p on p.doc_id = x.doc_id join sizes q on q.doc_id = y.doc_id
    group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach as (
    select doc_id as node, doc_id as far from documents
    union
    select reach.node, links.b from reach join links on links.a = reach.far
), least as (select node, min(far) as component_id from reach group by node)
select s.doc_id, cast(s.n as bigint) as n_shingles, l.component_id, s.doc_id = l.component_id as kept
from sizes s join least l on l.node = s.doc_id
"""

OP6_SQL = r"""
with article as (
    select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<(br|/?p|/?h[1-6])>', ' ', 'g') as t from pages
), plain as (
    select page_id, url, regexp_replace(t, '<[^>]*>', '', 'g') as t from article
), decoded as (
    select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(x27|39);?', chr(39), 'g'), '&amp;?', '&', 'g') as t from plain
), text as (
    select page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) as text from decoded
)
select page_id, url, text, cast(length(text) as bigint) as n_chars from text
"""

OP7_SQL = r"""
with sized as (
    select doc_id, strlen(coalesce(text, '')) as n_bytes, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from documents
), levels as (
    select doc_id, n_bytes, d.depth, h >> (60 - d.depth) as prefix from sized, (select unnest(range(0, 61)) as depth) d
), fits as (
    select depth, prefix from levels group by depth, prefix having sum(n_bytes) <= 1048576
), least as (
    select doc_id, n_bytes, min_by(prefix, depth) as prefix, min(depth) as depth from levels join fits using (depth, prefix) group by doc_id, n_bytes
)
select doc_id, case when depth = 0 then '' else lpad(bin(prefix), cast(depth as int), '0') end as shard, cast(depth as int) as depth,
    cast(n_bytes as bigint) as n_bytes, false as oversized
from least
"""

OP9_SQL = r"""
with words as (
    select doc_id, row_number() over () as row, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
    from documents
), starts as (
    select row, unnest(range(1, len(w) - 33)) as q from words where len(w) >= 35
), windows as (
    select starts.row, q, md5(array_to_string(w[q:q + 34], ' ')) as h from starts join words using (row)
), repeats as (
    select row, q from windows where h in (select h from windows group by h having count(*) > 1)
), gone as (
    select row, list(distinct p) as gone from (select row, unnest(range(q, q + 35)) as p from repeats) group by row
), kept as (
    select doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
        array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)), ' ') as text
    from words left join gone using (row)
)
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(text) as kept_sha256 from kept
"""

#: CRC-32 of short ASCII texts: its table, and the sum of a text ``x`` by it.
_CRC_TABLE = """crc as (
    select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
)"""


def _crc(x: str) -> str:
    codes = f"list_transform(string_split({x}, ''), lambda ch: cast(ascii(ch) as bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = rf"""
with {_CRC_TABLE}, given as (
    select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own
    from conversations where conv_id is not null group by conv_id
), taken as (
    select conv_id, own, {_crc("cast(conv_id as varchar)")} % 4 as h from given, crc
), built as (
    select c.conv_id, list_concat(coalesce(s.own, [])[1:c.h], c.own[c.h + 1:]) as turns
    from taken c left join given s on s.conv_id = c.conv_id - c.conv_id % 20
), paths as (
    select conv_id, len(turns) as n, d, turns[1:d] as path from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from built)
), nodes as (
    select d, path, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = d), '')) as ends_sha256
    from paths group by d, path
), kids as (
    select path[1:d - 1] as path, d - 1 as d, count(*) as n_children from nodes where d > 0 group by all
), held as (
    select nodes.*, coalesce(n_children, 0) as n_children,
        case when nodes.d = 0 then 0 else (n_convs - 1) * len(list_filter(string_split_regex(nodes.path[nodes.d].t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) end as saved
    from nodes left join kids on kids.d = nodes.d and kids.path = nodes.path
), up as (
    select path[1:e] as path, e, n_children, saved from (select path, n_children, saved, unnest(range(0, d + 1)) as e from held)
), sums as (
    select path, e as d, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens from up group by path, e
)
select x.conv_id, cast(x.d as bigint) as depth, p.conv_id as parent_conv_id, cast(x.n_convs as bigint) as n_convs, cast(x.n_children as bigint) as n_children,
    cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, x.ends_sha256
from held x join sums on sums.d = x.d and sums.path = x.path left join nodes p on p.d = x.d - 1 and p.path = x.path[1:x.d - 1]
"""

def _then(state: str, cost: str, mark: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{mark}'}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


_FAR = "{'c': cast(1000000000 as bigint), 'a': ''}"
_USER = _least("su", *(_then(s, "2", "I") for s in ("s0", "ss", "sa")))
_ASSISTANT = _least("sa", _then("u", "2", "I"))
_BEFORE_USER = _least("s0", "ss", "a")
_MOVES = {
    "s0": _then("s0", "3", "D"),
    "ss": _least(_then("ss", "3", "D"), f"case when r = 's' and not gone then {_then('s0', 'cut', 'K')} else {_FAR} end"),
    "su": _least(
        _then("u", "3", "D"), f"case when gone then {_FAR} when r = 'u' then {_then(_BEFORE_USER, 'cut', 'K')} else {_then(_BEFORE_USER, '2 + cut', 'R')} end"
    ),
    "sa": _least(_then("a", "3", "D"), f"case when gone then {_FAR} when r = 'a' then {_then('u', 'cut', 'K')} else {_then('u', '2 + cut', 'R')} end"),
}

OP12_SQL = rf"""
with recursive {_CRC_TABLE}, drawn as (
    select conv_id, coalesce(cast(conv_id as varchar), ' ') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {_crc("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as lot
    from conversations, crc
), damaged as (
    select conv, turn, case when lot = 4 then 'user' else role end as role,
        case when lot = 1 then '' when lot = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case lot when 0 then 0 when 3 then 2 else 1 end)) as copy
    from drawn
), numbered as (
    select *, row_number() over (partition by conv order by turn nulls first, role, text, copy) as i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ink from damaged
), faults as (
    select *, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end as r,
        case when ink = '' then 'blank' when row_number() over (partition by conv, role, text order by i) > 1 then 'duplicate'
            when right(ink, 1) not in ('.', '!', '?') then 'truncated' else 'none' end as fault
    from numbered
), chosen as (
    select conv, i, r, fault in ('blank', 'duplicate') as gone, cast(fault = 'truncated' as int) as cut from faults
), steps as (
    select distinct conv, cast(0 as bigint) as i, {{'c': cast(0 as bigint), 'a': ''}} as s0, {_FAR} as ss, {_FAR} as su, {_FAR} as sa from chosen
    union all
    select conv, i, {", ".join(_MOVES.values())}
    from (
        select *, {_ASSISTANT} as a
        from (select c.conv, c.i, c.r, c.gone, c.cut, s0, ss, su, sa, {_USER} as u from steps p join chosen c on c.conv = p.conv and c.i = p.i + 1)
    )
), best as (
    select conv, {_least("s0", "a")} as best
    from (select conv, s0, {_ASSISTANT} as a from (select *, {_USER} as u from steps join (select conv, max(i) as i from chosen group by conv) using (conv, i)))
), marks as (
    select conv, length(replace(best.a, 'D', '')) % 2 as odd, unnest(string_split(best.a, '')) as mark, generate_subscripts(string_split(best.a, ''), 1) as k from best
), placed as (
    select *, count(*) filter (mark <> 'I') over w as i, count(*) filter (mark <> 'D') over w - odd as o from marks window w as (partition by conv order by k rows unbounded preceding)
), repaired as (
    select p.conv, sha256(string_agg(case when mark = 'K' then role when o % 2 = 1 then 'user' else 'assistant' end || ':' || case when mark = 'I' then '' else text end, chr(10) order by k)) as sha
    from placed p left join numbered n on n.conv = p.conv and n.i = p.i and p.mark <> 'I' where mark <> 'D' group by p.conv
), pairs as (
    select *, lag(left(role, 1)) over (partition by conv order by i) || left(role, 1) as pair from faults
), counts as (
    select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
    from pairs group by conv
)
select d.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id, conv from drawn) d left join counts using (conv) left join best using (conv) left join repaired using (conv)
"""

ORACLES: dict[str, str] = {
    "op3_near_duplicates": OP3_SQL,
    "op6_html_text": OP6_SQL,
    "op7_sharding": OP7_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_structure_repair": OP12_SQL,
}
