"""SQL twins of results that SQL can express: by definition, without signatures or automata."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, between: str) -> str:
    return f"list_filter(string_split_regex({_LOWER.format(text)}, '{between}'), lambda w: w <> '')"


def _runs(size: str) -> str:
    """All runs of ``size`` words of the list ``w``."""
    return f"list_transform(range(1, len(w) - ({size}) + 2), lambda i: array_to_string(list_slice(w, i, i + ({size}) - 1), ' '))"


#: Near-duplicate groups: all pairs that share a shingle, then everything that links reach.
NEAR_DUPLICATES = f"""
with recursive d as (
  select doc_id, {_words("coalesce(text, '')", "[\\x20\\x09-\\x0D]+")} as w from documents
), s as (
  select doc_id, unnest(list_distinct({_runs("least(5, len(w))")})) as g from d where len(w) > 0
), n as (
  select doc_id, count(*) as n from s group by 1
), shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
  select x, y from shared join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)
), both_ways as (
  select x, y from links union all select y, x from links
), reach as (
  select doc_id as a, doc_id as b from documents union select r.a, e.y from reach r join both_ways e on r.b = e.x
), least_of as (
  select a, min(b) as component_id from reach group by 1
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n on d.doc_id = n.doc_id join least_of on a = d.doc_id
"""

_PLAIN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Contamination: windows of items joined with windows of documents.
CONTAMINATION = f"""
with items as (
  select cast(item_id as varchar) as item_id, {_words("coalesce(text, '')", _PLAIN)} as w from benchmark
), iw as (
  select distinct item_id, least(10, len(w)) as k, unnest({_runs("least(10, len(w))")}) as g from items where len(w) > 0
), d as (
  select doc_id, {_words("coalesce(text, '')", _PLAIN)} as w from documents
), dw as (
  select doc_id, k, unnest({_runs("k")}) as g, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from iw) where len(w) >= k
), hits as (
  select doc_id, item_id, dw.k, i from dw join iw on dw.g = iw.g and dw.k = iw.k
), words as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by 1
), named as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by 1
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words on d.doc_id = words.doc_id left join named on d.doc_id = named.doc_id
"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters, by the rule of its polynomial: eight steps a byte."""
    turned = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    codes = f"list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint))"
    return f"xor(list_reduce({codes}, lambda a, b: {turned}), 4294967295)"


#: Levels of a source's tree, and of the tree of sources, that the twin goes through: enough for 16 to that power of nodes.
_DEPTH = 6


def _levels(name: str, leaves: str) -> str:
    """Tables ``{name}0 (k, i, n, node)``, ``{name}1`` ...: a key's nodes at each level."""
    out = [f"{name}0 as materialized ({leaves})"]
    for j in range(_DEPTH):
        node = "case when any_value(n) = 1 then any_value(node) else sha256(string_agg(node, '' order by i)) end"
        out.append(f"{name}{j + 1} as materialized (select k, i // 16 as i, (any_value(n) + 15) // 16 as n, {node} as node from {name}{j} group by k, i // 16)")
    return ", ".join(out)


def _paths(name: str) -> str:
    """Table ``{name}_path (k, i, l0, r0, l1, r1, ...)``: the joined siblings before and after a leaf's node at each level."""
    sides = []
    for j in range(_DEPTH):
        at = f"(p.i // {16**j})"
        for side, sign in (("l", "<"), ("r", ">")):
            run = f"select string_agg(s.node, '' order by s.i) from {name}{j} s where s.k is not distinct from p.k and s.i // 16 = {at} // 16 and s.i {sign} {at}"
            sides.append(f"coalesce(({run}), '') as {side}{j}")
    return f"{name}_path as materialized (select p.k, p.i, {', '.join(sides)} from {name}0 p)"


def _leaf(text: str) -> str:
    field = "case when {0} is null then '-' else octet_length(encode({0}::varchar)) || ':' || {0}::varchar end"
    return "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _manifest() -> str:
    """Places by window functions, levels by grouping, siblings by their places, and one fold a level."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    levels = [(x, j) for x in "st" for j in range(_DEPTH)]
    proof = " || ".join(f"{x}p.l{j} || {x}p.r{j}" for x, j in levels)
    folds = [f"case when {x}.n <= {16**j} then f{k} else sha256({x}p.l{j} || f{k} || {x}p.r{j}) end as f{k + 1}" for k, (x, j) in enumerate(levels)]
    return f"""
with d as materialized (
  select doc_id, source, {_leaf("text")} as leaf, case when {crc32("doc_id::varchar")} % 5 = 0 then {_leaf(lower)} else {_leaf("text")} end as f0
  from documents
), placed as materialized (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from d
), {_levels("s", "select source as k, i, n, leaf as node from placed")}, {_paths("s")}, tops as materialized (
  select k as source, node, row_number() over (order by k nulls first) - 1 as i, count(*) over () as n from s{_DEPTH}
), {_levels("t", "select 0 as k, i, n, node from tops")}, {_paths("t")}, folded as (
  select s.doc_id, s.leaf, t.node as subroot, (select node from t{_DEPTH}) as root, sha256({proof}) as proof_sha256, s.f0, {", ".join(folds)}
  from placed s join s_path sp on sp.k is not distinct from s.source and sp.i = s.i
  join tops t on t.source is not distinct from s.source join t_path tp on tp.i = t.i
)
select doc_id, leaf, subroot, root, proof_sha256, f{len(levels)} as folded_root, f{len(levels)} = root as verified from folded
"""


#: The manifest's trees level by level.
MANIFEST = _manifest()

#: The trie by definition: nodes are distinct lists of first turns, subtrees what conversations go through after a node.
TRIE = f"""
with t as materialized (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as w,
    conv_id - conv_id % 5 as b, {crc32("any_value(conv_id)::varchar")} % 9 as h
  from conversations where conv_id is not null group by conv_id
), r as materialized (
  select t.conv_id, case when t.conv_id % 5 = 0 then t.w else list_concat(list_slice(coalesce(o.w, []), 1, t.h), list_slice(t.w, t.h + 1, len(t.w))) end as w
  from t left join t o on o.conv_id = t.b
), steps as (
  select conv_id, w, unnest(range(0, len(w) + 1)) as d from r
), p as materialized (
  select conv_id, d, sha256(to_json(list_slice(w, 1, d))::varchar) as key, case when d > 0 then sha256(to_json(list_slice(w, 1, d - 1))::varchar) end as above,
    case when d > 0 then octet_length(encode(w[d].text)) else 0 end as bytes, d = len(w) as last
  from steps
), n as materialized (
  select key, any_value(above) as above, any_value(d) as depth, count(*) as n_convs, min(conv_id) as conv_id, any_value(bytes) as bytes,
    string_agg(case when last then conv_id::varchar end, ',' order by conv_id) as ends
  from p group by key
), c as materialized (
  select n.*, coalesce(k.n, 0) as n_children from n left join (select above, count(*) as n from n group by above) k on k.above = n.key
), below as (
  select distinct a.key, b.key as part from p a join p b on a.conv_id = b.conv_id and a.d <= b.d
), sums as (
  select below.key, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * bytes)::bigint as saved_tokens
  from below join c on c.key = below.part group by below.key
)
select c.conv_id, c.depth, u.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, sha256(coalesce(c.ends, '')) as ends_sha256
from c join sums on sums.key = c.key left join n u on u.key = c.above
"""

#: Repeats by definition: every string of 100 bytes, its first place, and what the others cover.
REPEATS = """
with d as materialized (
  select doc_id, hex(encode(coalesce(text, ''))) as x from documents
), w as materialized (
  select doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) as g from (select doc_id, x, unnest(range(0, len(x) // 2 - 99)) as i from d where len(x) >= 200)
), first as (
  select g, min({'doc_id': doc_id, 'i': i}) as f from w group by g having count(*) > 1
), gone as (
  select doc_id, i, max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before
  from w join first using (g) where {'doc_id': doc_id, 'i': i} <> f
), cuts as (
  select doc_id, i, sum(case when i <= before + 100 then 0 else 1 end) over (partition by doc_id order by i) as span from gone
), spans as (
  select doc_id, span, min(i) as a, max(i) + 100 as b from cuts group by doc_id, span
), lists as (
  select doc_id, list(a order by a) as a, list(b order by a) as b, sum(b - a)::bigint as n from spans group by doc_id
)
select doc_id, len(x) // 2 as n_bytes, coalesce(n, 0) as n_removed, coalesce(len(a), 0) as n_spans,
  sha256(unhex(case when a is null then x else array_to_string(
    list_transform(range(1, len(a) + 2), lambda k: substr(x, 2 * coalesce(b[k - 1], 0) + 1, 2 * (coalesce(a[k], len(x) // 2) - coalesce(b[k - 1], 0)))), '') end)) as kept_sha256
from d left join lists using (doc_id)
"""
