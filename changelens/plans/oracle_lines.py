"""SQL of the line operators: hunks by patience difference, covered lines.

The recursion takes the segments of all files a round further: equal ends go, lines that
occur once on both sides are anchors, and a longest rising run of them, found by a table
of lengths, cuts the segment.
"""

from __future__ import annotations

SNAPSHOT_HUNKS = """snapshot_pairs as (
  select repo, path, string_split(b.content, chr(10)) as b, string_split(h.content, chr(10)) as h
  from snapshot_status s join base_files b using (repo, path) join head_files h using (repo, path) where s.status = 'M'),
segments as (
  select repo, path, 0::bigint as pb, 0::bigint as ph, b, h, false as done from snapshot_pairs
  union all
  (with firsts as (
    select *, coalesce(nullif(list_position(list_transform(range(1, least(len(b), len(h)) + 1), lambda i: b[i] = h[i]), false), 0) - 1,
                       least(len(b), len(h))) as p
    from segments where not done),
  rests as (select repo, path, pb + p as pb, ph + p as ph, b[p + 1:] as b, h[p + 1:] as h from firsts),
  lasts as (
    select *, coalesce(nullif(list_position(list_transform(range(0, least(len(b), len(h))), lambda i: b[len(b) - i] = h[len(h) - i]), false), 0) - 1,
                       least(len(b), len(h))) as s
    from rests),
  inner_parts as (select repo, path, pb, ph, b[:len(b) - s] as b, h[:len(h) - s] as h from lasts),
  anchored as (
    select *, coalesce(list_sort(list_transform(list_intersect(
        list_transform(list_filter(map_entries(list_histogram(b)), lambda e: e.value = 1), lambda e: e.key),
        list_transform(list_filter(map_entries(list_histogram(h)), lambda e: e.value = 1), lambda e: e.key)),
      lambda x: {'b': list_position(b, x)::bigint, 'h': list_position(h, x)::bigint})), []) as a
    from inner_parts),
  lengths as (
    select *, list_reduce(a, lambda acc, x: list_append(acc,
        {'v': x.h, 'l': 1 + coalesce(list_max(list_transform(list_filter(acc, lambda e: e.v < x.h), lambda e: e.l)), 0)}),
      cast([] as struct(v bigint, l bigint)[])) as d
    from anchored),
  runs as (
    select repo, path, pb, ph, b, h, list_transform(list_reverse(list_reduce(range(0, len(d)), lambda acc, i:
        case when d[len(d) - i].l = acc.need and (acc.need = acc.most or d[len(d) - i].v < acc.v)
          then {'most': acc.most, 'need': acc.need - 1, 'v': d[len(d) - i].v, 'at': list_append(acc.at, len(d) - i)} else acc end,
      {'most': coalesce(list_max(list_transform(d, lambda e: e.l)), 0)::bigint, 'need': coalesce(list_max(list_transform(d, lambda e: e.l)), 0)::bigint,
       'v': 0::bigint, 'at': cast([] as bigint[])}).at), lambda i: a[i]) as k
    from lengths),
  cuts as (
    select repo, path, pb, ph, b, h, len(k) = 0 as done,
      list_prepend({'b': 0::bigint, 'h': 0::bigint}, k) as f, list_append(k, {'b': len(b) + 1, 'h': len(h) + 1}) as t,
      unnest(range(1, len(k) + 2)) as i
    from runs)
  select repo, path, pb + f[i].b, ph + f[i].h, b[f[i].b + 1:t[i].b - 1], h[f[i].h + 1:t[i].h - 1], done
  from cuts where t[i].b - f[i].b > 1 or t[i].h - f[i].h > 1)),
snapshot_hunks as (
  select repo, path, pb + cast(len(b) > 0 as bigint) as base_start, len(b) as base_lines,
         ph + cast(len(h) > 0 as bigint) as head_start, len(h) as head_lines from segments where done
  union all
  select repo, path, 0, 0, 1, len(string_split(content, chr(10))) from snapshot_status join head_files using (repo, path) where status = 'A'
  union all
  select repo, path, 1, len(string_split(content, chr(10))), 0, 0 from snapshot_status join base_files using (repo, path) where status = 'D')"""

# Lines that coverage data of a head file mention, and whether they ran: see views.line_profiles.
PROFILE_LINES = """profiled as (
  select repo, doc_id % 100 as pr_id, path, doc_id, regexp_extract(path, '(\\.[^./]*)$', 1) as ext,
         len(string_split(h.content, chr(10))) as n_lines
  from head_files h join (select repo, path, doc_id from code_files) using (repo, path)),
profile_lines as (
  select repo, pr_id, path, 4 * k + d as no, (doc_id + k) % 3 > 0 as ran
  from (select *, unnest(range(0, (n_lines + 3) // 4)) as k from profiled where ext = '.go'), (values (1), (2), (3)) as t(d)
  union all
  select repo, pr_id, path, no, (no + doc_id) % 3 = 0
  from (select *, unnest(range(1, n_lines + 1)) as no from profiled where ext = '.py') where (no + doc_id) % 3 < 2
  union all
  select repo, pr_id, path, no, (no + doc_id) % 2 = 1
  from (select *, unnest(range(1, n_lines + 1)) as no from profiled where ext in ('.js', '.ts')) where no % 5 > 0)"""


def covered(changed: str, keys: str) -> str:
    """Counts per file from `changed` (keys, no), distinct lines."""
    return f"""
select {keys}, count(*) as n_new, count(ran) as n_known, count(*) filter (where ran) as n_covered,
       bool_or(mentioned) as has_data
from (select {keys}, c.no, p.ran, f.path is not null as mentioned from {changed} c
      left join profile_lines p using ({keys}, no)
      left join (select distinct {keys} from profile_lines) f using ({keys}))
group by {keys}"""


# Deleted and added files of one repository: equal texts by rank, then mutual best partners.
SNAPSHOT_RENAMES = """moved_files as (
  select repo, unnest(case when doc_id % 6 = 1 then ['moved/' || path] when doc_id % 60 = 2 then [path, 'moved/' || path]
                      else [path] end) as path,
         case when doc_id % 12 = 7 then h.content || chr(10) || 'moved' else h.content end as content
  from head_files h join (select repo, path, doc_id from code_files) using (repo, path)),
moved_status as (
  select repo, path, case when b.content is null then 'A' when h.content is null then 'D' else 'M' end as status
  from base_files b full join moved_files h using (repo, path) where b.content is distinct from h.content),
moved as (
  select s.repo, s.path, s.status, coalesce(b.content, h.content) as content
  from moved_status s left join base_files b on s.repo = b.repo and s.path = b.path
  left join moved_files h on s.repo = h.repo and s.path = h.path where s.status in ('A', 'D')),
ranked as (select *, row_number() over (partition by repo, content, status order by path) as k from moved),
equal_files as (
  select d.repo, d.path as old_path, a.path from ranked d join ranked a using (repo, content, k)
  where d.status = 'D' and a.status = 'A'),
rest as (
  select * from moved m
  where not exists (select 1 from equal_files e where e.repo = m.repo
                    and ((m.status = 'D' and e.old_path = m.path) or (m.status = 'A' and e.path = m.path)))
  union all
  select repo, path, 'kept', content from base_files b
  where not exists (select 1 from moved_status s where s.repo = b.repo and s.path = b.path and s.status = 'D')),
bags as (
  select repo, path, status, line, count(*) as n, sum(count(*)) over (partition by repo, path, status) as n_all
  from (select repo, path, status, unnest(string_split(content, chr(10))) as line from rest)
  group by repo, path, status, line),
shares as (
  select d.status, d.repo, d.path as old_path, a.path,
         cast(sum(least(d.n, a.n)) as double) / cast(greatest(any_value(d.n_all), any_value(a.n_all)) as double) as share
  from bags d join bags a using (repo, line) where d.status in ('D', 'kept') and a.status = 'A'
  group by d.status, d.repo, d.path, a.path),
mutual as (
  select repo, old_path, path, share,
         row_number() over (partition by repo, old_path order by share desc, path) as from_old,
         row_number() over (partition by repo, path order by share desc, old_path) as from_new
  from shares where share >= 0.5 and status = 'D'),
renamed as (
  select repo, old_path, path, cast(100 as bigint) as similarity from equal_files
  union all
  select repo, old_path, path, cast(floor(share * 100) as bigint) from mutual where from_old = 1 and from_new = 1),
copied as (
  select s.repo, s.old_path, s.path, cast(floor(share * 100) as bigint) as similarity
  from shares s where share >= 0.5 and status = 'kept'
    and not exists (select 1 from renamed r where r.repo = s.repo and r.path = s.path)
  qualify row_number() over (partition by s.repo, s.path order by share desc, s.old_path) = 1),
snapshot_renames as (
  select repo, path, 'R' as status, old_path, similarity from renamed
  union all
  select repo, path, 'C', old_path, similarity from copied
  union all
  select repo, path, status, '', cast(0 as bigint) from moved_status s
  where not exists (select 1 from renamed r where r.repo = s.repo
                    and ((s.status = 'A' and r.path = s.path) or (s.status = 'D' and r.old_path = s.path)))
    and not exists (select 1 from copied c where s.status = 'A' and c.repo = s.repo and c.path = s.path))"""
