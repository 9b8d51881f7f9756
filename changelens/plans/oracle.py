"""SQL for DuckDB that states every driver query on the same tables.

Shared steps are common table expressions; `_sql` puts the needed ones, with
their own inputs, in front of a query.
"""

from __future__ import annotations

from changelens.config import JobConfig
from changelens.functions import fixed, templates
from changelens.functions.text import glob_regex
from changelens.operators.dedup import SEPARATOR
from changelens.plans import oracle_lines
from changelens.plans.views import EXTENSIONS, HEADERS, NESTED_DECLARATIONS

CONFIG = JobConfig()
_FENCED = r"(?m)^[ \t]*```[^\n]*\n((?s:.*?))(?:\n?^[ \t]*```[ \t]*$|\n?\z)"
NL = "chr(10)"
TAB = "chr(9)"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill(template: str, **values: str) -> str:
    sql = _lit(template)
    for name, value in values.items():
        sql = f"replace({sql}, '{{{name}}}', {value})"
    return sql


def _case(key: str, table: dict[str, str], default: str) -> str:
    branches = " ".join(f"when {_lit(k)} then {_lit(v)}" for k, v in table.items())
    return f"(case {key} {branches} else {default} end)"


def _text(value: str) -> str:
    return f"cast({value} as varchar)"


def _repo(number: str) -> str:
    return f"('repo' || {_text(number + ' % 10')})"


def _ext_of(number: str) -> str:
    return _case(f"{number} % 8", {}, "''").replace(
        "case " + f"{number} % 8  else",
        f"case {number} % 8 " + " ".join(f"when {i} then {_lit(e)}" for i, e in enumerate(EXTENSIONS)) + " else",
    )


def _base(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def _ext(path: str) -> str:
    return f"regexp_extract({path}, '(\\.[^./]*)$', 1)"


def _stem(path: str) -> str:
    return f"regexp_replace({_base(path)}, '\\.[^.]*$', '')"


def _last_dot(text: str) -> str:
    return f"regexp_extract({text}, '([^.]*)$', 1)"


def _dir(path: str) -> str:
    return f"(case when contains({path}, '/') then regexp_replace({path}, '/[^/]*$', '') else '.' end)"


def _module(path: str) -> str:
    return f"(case when contains({path}, '/') then regexp_extract({path}, '^([^/]*)/', 1) end)"


def _language(path: str) -> str:
    return _case(f"lower({_ext(path)})", fixed.LANGUAGE_BY_EXTENSION, _lit(fixed.UNKNOWN_LANGUAGE))


def _test_language(path: str) -> str:
    five = {e: n for e, n in fixed.LANGUAGE_BY_EXTENSION.items() if n in fixed.TESTABLE_LANGUAGES}
    return _case(f"lower({_ext(path)})", five, "'go'")


def _language_ext(language: str) -> str:
    five = {n: e for e, n in fixed.LANGUAGE_BY_EXTENSION.items() if n in fixed.TESTABLE_LANGUAGES}
    return _case(language, five, "'.go'")


def _display(path: str) -> str:
    return _case(_last_dot(path), fixed.DISPLAY_LANGUAGE, _last_dot(path))


def _framework(language: str, extra: bool = False) -> str:
    table = {**fixed.FRAMEWORKS, **(fixed.EXTRA_FRAMEWORKS if extra else {})}
    return _case(language, table, _lit(fixed.DEFAULT_FRAMEWORK))


def _cap(text: str) -> str:
    return f"(upper(substr({text}, 1, 1)) || substr({text}, 2))"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def _words(text: str) -> str:
    return f"regexp_split_to_array({_trim(text)}, '\\s+')"


def _flat_name(path: str, language: str) -> str:
    name = _stem(path)
    return (
        f"(case {language} when 'go' then {name} || '_test.go' when 'python' then 'test_' || {name} || '.py' "
        f"else 'test_' || {name} || {_language_ext(language)} end)"
    )


def _beside(path: str) -> str:
    name, ext = _stem(path), _last_dot(_base(path))
    return (
        f"({_dir(path)} || '/' || (case when {ext} = 'go' then {name} || '_test.go' "
        f"when {ext} = 'py' then 'test_' || {name} || '.py' "
        f"when {ext} in ('js', 'ts') then {name} || '.test.' || {ext} "
        f"when {ext} = 'java' then {name} || 'Test.java' else {name} || '_test.' || {ext} end))"
    )


def _functional_name(symbol: str, language: str) -> str:
    return f"('test_' || {symbol} || '_functional' || {_language_ext(language)})"


def _is_test(path: str) -> str:
    base = _base(path)
    return f"({base} like '%\\_test.go' escape '\\' or {base} like 'test\\_%' escape '\\' or {base} like '%.test.%')"


def _generated_path() -> str:
    return f"(case when doc_id % 7 = 3 then path else {_beside('path')} end)"


def _by_language(language: str, table: dict[str, str], **values: str) -> str:
    if not table:
        return "''"
    branches = " ".join(f"when {_lit(k)} then {_fill(v, **values)}" for k, v in table.items())
    return f"(case {language} {branches} else '' end)"


def _function_code(kind: str, language: str, name: str) -> str:
    branches = " ".join(
        f"when {_lit(k)} then {_by_language(language, t, name=name, Name=_cap(name))}"
        for k, t in templates.FUNCTION.items()
    )
    return f"(case {kind} {branches} end)"


def _percent(word: str) -> str:
    return f"try_cast(regexp_replace({word}, '%$', '') as double)"


_HEADER_SQL = "case " + " ".join(
    f"when {_ext_of('doc_id')} = {_lit(ext)} then {_fill(template, id=_text('doc_id'))}"
    for ext, template in HEADERS.items()
) + " else '' end"

_KINDS_SQL = "(values " + ", ".join(
    f"({_lit(k)}, {_lit(s)}, {_lit(d)}, {i})" for i, (k, s, d) in enumerate(fixed.FUNCTION_KINDS)
) + ") as k(case_type, suffix, ending, case_ord)"

_SUITE_BODY = _fill(
    "package suite\n\nfunc TestLoad_{id}{kind}(t *testing.T) {\n\tfor {\n\t\tload_{id}(1, 2)\n\t}\n}\n\n"
    "func TestRemoved_{id}_HappyPath(t *testing.T) {}\n"
    "def test_load_{id}_extra(a):\n    assert a\ndef test_load_{id}_last():\n    assert load_{id}(1, 2)\n\n",
    id=_text("doc_id"),
    kind="(case when doc_id % 3 = 0 then '_HappyPath' else '_Other' end)",
)
_HELPER_BODY = _fill(
    "package suite\n\nfunc TestDeep_{id}(t *testing.T) {\n\tcheck_{id}(t)\n}\n\nfunc check_{id}(t *testing.T) {\n"
    "\tif (true) { verify_{id} (t, 1) }\n}\n\nfunc verify_{id}(t *testing.T, n int) {\n\tload_{id}(n, 2)\n}\n\n"
    "func TestRound_{id}(t *testing.T) {\n\tping_{id}()\n}\nfunc ping_{id}() { pong_{id}() }\nfunc pong_{id}() { ping_{id}() }\n"
    "func TestNext_{id}(t *testing.T) {\n\tcheck_{next}(t)\n}\nfunc TestNothing_{id}(t *testing.T) {}\n"
    "def test_direct_{id}():\n    assert load_{id}(1, 2)\n",
    id=_text("doc_id"),
    next=_text("doc_id + 10"),
)
_GENERATED_BODY = "('package main' || chr(10) || chr(10)" + "".join(
    " || "
    + _fill(
        "func TestLoad_{id}" + suffix + "(t *testing.T) {\n\tload_{id}(1, 2)\n}\n\n", id=_text("doc_id")
    )
    for _, suffix, _ in fixed.FUNCTION_KINDS
) + ")"

_GO_FUNCTION = (
    r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(([^)]*)\)"
)
_GO_STRUCT = r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"
_PCT_TEXT = "cast(cast(pct as decimal(10,2)) as varchar)"


def _blocks(name: str, files: str, end: str) -> str:
    """Line state machine: blocks of test files; `end` says which line ends a Go block."""
    return f"""
{name}_lines as (
  select repo, path, line_no, line, {_trim('line')} as t,
         ({_trim('line')} like 'func Test%' or {_trim('line')} like 'def test\\_%' escape '\\') as is_start
  from (select repo, path, unnest(string_split(content, {NL})) as line,
               generate_subscripts(string_split(content, {NL}), 1) as line_no from {files})),
{name}_numbered as (
  select *, sum(case when is_start then 1 else 0 end) over (partition by repo, path order by line_no) as block_id
  from {name}_lines),
{name}_heads as (
  select *, first_value(t) over (partition by repo, path, block_id order by line_no) as head
  from {name}_numbered where block_id > 0),
{name}_ends as (
  select *, min(case when not is_start and (({end}) or (head like 'def test\\_%' escape '\\' and t in ('', '}}')))
                     then line_no end)
            over (partition by repo, path, block_id) as end_line
  from {name}_heads),
{name}_blocks as (
  select repo, path, cast(block_id - 1 as bigint) as block_no,
         string_agg(line || {NL}, '' order by line_no) as block, any_value(head) as head
  from {name}_ends where end_line is null or line_no <= end_line group by repo, path, block_id),
{name}_named as (
  select repo, path, block_no, block,
         case when head like 'func Test%' then regexp_replace({_words('head')}[2], '\\(t$', '')
              else regexp_replace({_words('head')}[2], '\\(\\):$', '') end as test_name
  from {name}_blocks)"""


_ANY_BRACE = "head like 'func Test%' and t = '}'"
_FIRST_COLUMN = "head like 'func Test%' and regexp_matches(line, '^\\}\\s*$')"

# name: (inputs, definition)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "code_files": (
        (),
        f"""code_files as (
  select doc_id, {_repo('doc_id')} as repo, doc_id % 100 as pr_id,
         (case when doc_id % 13 = 0 then '' else source || '/' || lang || '/' end)
           || 'f' || {_text('doc_id')} || {_ext_of('doc_id')} as path,
         ({_HEADER_SQL}) || text as content
  from documents)""",
    ),
    "base_files": (("code_files",), "base_files as (select repo, path, content from code_files where doc_id % 10 <> 9)"),
    "head_files": (
        ("code_files",),
        f"""head_files as (
  select repo, path, case when doc_id % 4 = 0
    then substr(content, strpos(content, {NL}) + 1) || {NL} || 'added ' || {_text('doc_id')}
    else content end as content
  from code_files where doc_id % 10 <> 8)""",
    ),
    "snapshot_status": (
        ("base_files", "head_files"),
        """snapshot_status as (
  select repo, path, case when b.content is null then 'A' when h.content is null then 'D' else 'M' end as status
  from base_files b full join head_files h using (repo, path)
  where b.content is distinct from h.content)""",
    ),
    "snapshot_hunks": (("snapshot_status",), oracle_lines.SNAPSHOT_HUNKS),
    "snapshot_renames": (("base_files", "head_files"), oracle_lines.SNAPSHOT_RENAMES),
    "profile_lines": (("head_files",), oracle_lines.PROFILE_LINES),
    "hunk_lines": (
        ("snapshot_hunks",),
        """new_line_numbers as (
  select repo, path, unnest(range(head_start, head_start + head_lines)) as no from snapshot_hunks where head_lines > 0)""",
    ),
    "patch_numbers": (
        ("code_files", "change_rows"),
        """patch_numbers as (
  select repo, pr_id, path, unnest(case when doc_id % 3 = 0 then [2, 3] else [2] end) as no
  from code_files semi join (select repo, path from change_rows where substr(status, 1, 1) in ('M', 'A')) using (repo, path))""",
    ),
    "snapshot_lines": (
        ("snapshot_status",),
        f"""snapshot_bags as (
  select repo, path, line, cast(sum(sign) as bigint) as balance from (
    select repo, path, unnest(string_split(content, {NL})) as line, 1 as sign from head_files
    union all
    select repo, path, unnest(string_split(content, {NL})) as line, -1 as sign from base_files)
  group by repo, path, line),
snapshot_lines as (
  select repo, path, cast(sum(greatest(balance, 0)) as bigint) as lines_added,
         cast(sum(greatest(-balance, 0)) as bigint) as lines_removed
  from snapshot_bags semi join snapshot_status using (repo, path) group by repo, path)""",
    ),
    "name_status": (
        ("code_files",),
        f"""name_status as (
  select doc_id, repo, pr_id, case doc_id % 10 when 9 then 'A' || {TAB} || path when 8 then 'D' || {TAB} || path
    when 7 then 'R100' || {TAB} || 'old/' || path || {TAB} || path else 'M' || {TAB} || path end as line
  from code_files)""",
    ),
    "change_rows": (
        ("name_status",),
        f"""change_rows as (
  select doc_id, repo, pr_id, {_words('line')}[1] as status, {_words('line')}[2] as path
  from name_status where len({_words('line')}) >= 2)""",
    ),
    "patches": (
        ("code_files",),
        f"""patches as (
  select repo, pr_id, path, '--- a/' || path || {NL} || '+++ b/' || path || {NL} || '@@ -1,2 +1,2 @@' || {NL}
    || ' context' || {NL} || '-before' || {NL} || '+after' || {NL}
    || case when doc_id % 3 = 0 then '+second' || {NL} else '' end as diff
  from code_files)""",
    ),
    "pr_files": (
        (),
        f"""pr_files as (
  select l_orderkey as pr_id, {_repo('l_orderkey')} as repo, l_linenumber as seq,
         'm' || {_text('l_suppkey % 10')} || '/f' || {_text('l_partkey')} || {_ext_of('l_partkey')} as path,
         case l_returnflag when 'A' then 'A' when 'R' then 'D' else 'M' end as status,
         cast(l_quantity as bigint) as lines_changed
  from lineitem)""",
    ),
    "pull_requests": (
        (),
        f"""pull_requests as (
  select o_orderkey as pr_id, {_repo('o_orderkey')} as repo, o_orderdate as created_at,
         'https://example.org/pull/' || {_text('o_orderkey')} as pr_url from orders)""",
    ),
    "symbols": (
        ("code_files",),
        f"""go_lines as (
  select repo, pr_id, path, unnest(string_split(content, {NL})) as l,
         generate_subscripts(string_split(content, {NL}), 1) as line from code_files where path like '%.go'),
go_functions as (
  select repo, pr_id, path, line, regexp_extract(l, '{_GO_FUNCTION}', 1) as receiver,
         regexp_extract(l, '{_GO_FUNCTION}', 2) as name, regexp_extract(l, '{_GO_FUNCTION}', 3) as params
  from go_lines where regexp_matches(l, '{_GO_FUNCTION}')),
go_structs as (
  select repo, pr_id, path, line, regexp_extract(l, '{_GO_STRUCT}', 1) as name
  from go_lines where regexp_matches(l, '{_GO_STRUCT}')),
script_hits as (
  select repo, pr_id, path, {_language('path')} as language,
         unnest(regexp_extract_all(content, '{fixed.SCRIPT_FUNCTION}', 1)) as a,
         unnest(regexp_extract_all(content, '{fixed.SCRIPT_FUNCTION}', 2)) as b,
         generate_subscripts(regexp_extract_all(content, '{fixed.SCRIPT_FUNCTION}', 1), 1) as pos
  from code_files where path like '%.js' or path like '%.ts'),
symbol_rows as (
  select repo, pr_id, path, 'go' as language, 'function' as kind, 'function' as type, name, line,
         case when params = '' then '' else regexp_replace(regexp_replace(params, '\\s+\\w+$', ''), ',\\s*', ',', 'g') end as args,
         '' as methods, 0 as n_methods, 0 as late, line as pos from go_functions
  union all
  select s.repo, s.pr_id, s.path, 'go', 'class', 'struct', s.name, s.line, '',
         coalesce(string_agg(f.name, ',' order by f.line), ''), count(f.name), 1, s.line
  from go_structs s left join go_functions f on s.repo = f.repo and s.path = f.path and s.name = f.receiver
  group by s.repo, s.pr_id, s.path, s.name, s.line
  union all
  select repo, pr_id, path, 'python', 'function', 'function',
         unnest(regexp_extract_all(content, '(?m)^def\\s+(\\w+)\\s*\\(', 1)), 0, '', '', 0, 0,
         generate_subscripts(regexp_extract_all(content, '(?m)^def\\s+(\\w+)\\s*\\(', 1), 1)
  from code_files where path like '%.py'
  union all
  select repo, pr_id, path, 'python', 'class', 'class',
         unnest(regexp_extract_all(content, '(?m)^class\\s+(\\w+)', 1)), 0, '', '', 0, 1,
         generate_subscripts(regexp_extract_all(content, '(?m)^class\\s+(\\w+)', 1), 1)
  from code_files where path like '%.py'
  union all
  select repo, pr_id, path, language, 'function', 'function',
         coalesce(nullif(a, ''), b), 0, '', '', 0, 0, pos
  from script_hits where coalesce(nullif(a, ''), b, '') <> ''
  union all
  select repo, pr_id, path, {_language('path')}, 'class', 'class',
         unnest(regexp_extract_all(content, 'class\\s+(\\w+)', 1)), 0, '', '', 0, 1,
         generate_subscripts(regexp_extract_all(content, 'class\\s+(\\w+)', 1), 1)
  from code_files where path like '%.js' or path like '%.ts'),
symbols as (
  select *, row_number() over (partition by repo, path order by late, pos) - 1 as ord from symbol_rows)""",
    ),
    "head_symbols": (
        ("head_files",),
        f"""head_symbols as (
  select distinct repo, unnest(
    case when path like '%.go' then list_concat(regexp_extract_all(content, '(?m){_GO_FUNCTION}', 2),
                                                regexp_extract_all(content, '(?m){_GO_STRUCT}', 1))
         when path like '%.py' then list_concat(regexp_extract_all(content, '(?m)^def\\s+(\\w+)\\s*\\(', 1),
                                                regexp_extract_all(content, '(?m)^class\\s+(\\w+)', 1))
         when path like '%.js' or path like '%.ts' then list_concat(
           regexp_extract_all(content, '{fixed.SCRIPT_FUNCTION}', 1),
           regexp_extract_all(content, '{fixed.SCRIPT_FUNCTION}', 2),
           regexp_extract_all(content, 'class\\s+(\\w+)', 1)) end) as name
  from head_files)""",
    ),
    "test_calls": (
        ("head_symbols",),
        f"""helper_lines as (
  select {_repo('doc_id')} as repo, doc_id, unnest(string_split(content, {NL})) as line,
         generate_subscripts(string_split(content, {NL}), 1) as line_no
  from (select doc_id, {_HELPER_BODY} || text as content from documents)),
helper_heads as (
  select *, sum(case when regexp_matches(line, '^[ \\t]*(?:func|def)[ \\t]') then 1 else 0 end)
            over (partition by doc_id order by line_no) as part from helper_lines),
helper_names as (
  select repo, doc_id, part, line, first_value(regexp_extract(line, '^[ \\t]*(?:func|def)[ \\t]+(?:\\([^)]*\\)[ \\t]*)?(\\w+)', 1))
            over (partition by doc_id, part order by line_no) as caller from helper_heads where part > 0),
test_calls as (
  select distinct repo, caller, callee
  from (select repo, caller, unnest(regexp_extract_all(line, '(\\w+)[ \\t]*\\(', 1)) as callee from helper_names where caller <> '')
  where callee <> caller and callee not in ({', '.join(_lit(w) for w in fixed.NOT_CALLED)})),
alive_functions as (
  select e.repo, e.caller as name from test_calls e join head_symbols h on h.repo = e.repo and h.name = e.callee
  union
  select e.repo, e.caller from alive_functions a join test_calls e on a.repo = e.repo and a.name = e.callee)""",
    ),
    "modified_symbols": (
        ("symbols", "change_rows"),
        """modified_symbols as (
  select s.* from symbols s semi join (select repo, path from change_rows where status like 'M%') c using (repo, path))""",
    ),
    "modified_modules": (
        ("change_rows",),
        f"""modified_modules as (
  select distinct repo, pr_id, {_module('path')} as module from change_rows
  where status like 'M%' and {_module('path')} is not null)""",
    ),
    "unit_cases": (
        ("symbols",),
        f"""unit_cases as (
  select repo, pr_id, path, language, name as symbol, ord, cast(case_ord as bigint) as case_ord, case_type,
         'Test' || {_cap('name')} || suffix as name, 'Test ' || name || ' ' || ending as description,
         {_function_code('case_type', 'language', 'name')} as code
  from symbols, {_KINDS_SQL} where kind = 'function'
  union all
  select repo, pr_id, path, language, owner, ord, pos - 1, 'method_test',
         'Test' || owner || '_' || {_cap('method')}, 'Test ' || owner || '.' || method,
         {_by_language('language', templates.METHOD, Owner='owner', method='method', Method=_cap('method'))}
  from (select repo, pr_id, path, language, name as owner, ord, unnest(string_split(methods, ',')) as method,
               generate_subscripts(string_split(methods, ','), 1) as pos
        from symbols where kind = 'class' and methods <> ''))""",
    ),
    "functional_cases": (
        ("modified_symbols",),
        f"""functional_cases as (
  select repo, pr_id, path, name as symbol, 'Test' || {_cap('name')} || '_E2E' as name,
         'End-to-end test for ' || name as description, 'e2e' as case_type,
         {_fill(templates.END_TO_END, Name=_cap('name'))} as code,
         {_functional_name('name', _test_language('path'))} as test_path
  from modified_symbols where language = 'go' and kind = 'class')""",
    ),
    "integration_cases": (
        ("modified_modules",),
        f"""integration_cases as (
  select repo, pr_id, module as symbol, 'Test' || {_cap('module')} || '_Integration' as name,
         'Integration test for ' || module || ' module' as description, 'integration' as case_type,
         {_fill(templates.INTEGRATION, Name=_cap('module'))} as code,
         'test_' || module || '_integration_test.go' as test_path
  from modified_modules)""",
    ),
    "unit_files": (
        ("unit_cases",),
        f"""case_texts as (
  select repo, path, count(*) as n_cases,
         string_agg((case when language = 'python' then '#' else '//' end) || ' ' || description || {NL}
           || code || {NL} || {NL}, '' order by ord, case_ord) as body
  from unit_cases group by repo, path),
unit_files as (
  select s.repo, s.pr_id, s.path, {_beside('s.path')} as test_path, coalesce(n_cases, 0) as n_cases,
         {_by_language('s.language', templates.HEADER, framework=_framework('s.language'))}
           || {NL} || {NL} || coalesce(body, '') as content
  from (select distinct repo, pr_id, path, language from symbols) s left join case_texts using (repo, path))""",
    ),
    "generated_files": (
        ("code_files",),
        f"""generated_files as (
  select repo, path, content
  from (select repo, {_generated_path()} as path, {_GENERATED_BODY} as content from code_files)
  where {_is_test('path')})""",
    ),
    "generated_tests": (
        ("code_files",),
        f"""generated_tests as (
  select repo, {_generated_path()} as path, 'TestLoad_' || {_text('doc_id')} || suffix as name
  from code_files, {_KINDS_SQL})""",
    ),
    "existing_tests": (
        ("code_files",),
        f"""existing_tests as (
  select repo, {_generated_path()} as path, {_SUITE_BODY} || content as content
  from code_files where doc_id % 5 <> 0)""",
    ),
    "existing_names": (
        ("existing_tests",),
        f"""existing_lines as (
  select repo, path, {_trim('line')} as t
  from (select repo, path, unnest(string_split(content, {NL})) as line from existing_tests)),
existing_names as (
  select repo, path, regexp_replace(regexp_replace({_words('t')}[2], '\\(t$', ''), '\\($', '') as test_name
  from existing_lines where t like 'func Test%'
  union all
  select repo, path, regexp_replace(regexp_replace({_words('t')}[2], '\\(\\):$', ''), ':$', '')
  from existing_lines where t like 'def test\\_%' escape '\\')""",
    ),
    "suite_blocks": (("existing_tests",), _blocks("suite", "existing_tests", _ANY_BRACE).strip()),
    "whole_blocks": (("existing_tests",), _blocks("whole", "existing_tests", _FIRST_COLUMN).strip()),
    "generated_blocks": (("generated_files",), _blocks("generated", "generated_files", _ANY_BRACE).strip()),
    "pairs": (
        ("generated_blocks", "existing_tests"),
        f"""pairs as (
  select repo, path, g.content as source, e.content as target
  from generated_files g full join existing_tests e using (repo, path)),
duplicates as (
  select distinct repo, path from generated_named join existing_tests using (repo, path)
  where contains(content, test_name)),
additions as (
  select repo, path, count(*) as n_new, string_agg(block || {NL} || {NL}, '' order by block_no) as added
  from generated_named left join existing_tests using (repo, path)
  where content is null or not contains(content, test_name) group by repo, path)""",
    ),
    "coverage_runs": (
        (),
        f"""coverage_runs as (
  select event_id as run_id, event_id as pr_id, {_repo('event_id')} as repo, user_id as repo_key, ts,
         case when event_type = 'view' then 'baseline' else 'pr' end as kind, least(value, 100.0::double) as pct
  from events)""",
    ),
    "coverage_logs": (
        ("coverage_runs",),
        f"""coverage_logs as (
  select *,
    (case when run_id % 5 = 0 then '?   ' || {TAB} || 'pkg/a' || {TAB} || '[no test files]' || {NL}
     else 'ok  ' || {TAB} || 'pkg/a' || {TAB} || '0.1s' || {TAB} || 'coverage: ' || {_PCT_TEXT} || '% of statements' || {NL} end)
     || 'total:' || {TAB} || '(statements)' || {TAB} || '1.00%' || {NL}
     || 'total:' || {TAB} || '(statements)' || {TAB} || {_PCT_TEXT} || '%' || {NL} as go_log,
    'File | % Stmts | % Branch | % Funcs | % Lines |' || {NL} || 'All files | 1 | 2 | 3 | ' || {_PCT_TEXT}
     || ' |' || {NL} as js_log,
    'Name Stmts Miss Cover' || {NL} || 'a.py 1 0 100%' || {NL} || 'TOTAL 9 3 ' || {_PCT_TEXT} || '%' || {NL} as py_log,
    case run_id % 4 when 0 then 'go' when 1 then 'python' when 2 then 'javascript' else 'unknown' end as project_type
  from coverage_runs)""",
    ),
    "log_percents": (
        ("coverage_logs",),
        f"""log_lines as (
  select run_id, tool, unnest(string_split(log, {NL})) as line,
         generate_subscripts(string_split(log, {NL}), 1) as line_no
  from (select run_id, 'go' as tool, go_log as log from coverage_logs
        union all select run_id, 'js', js_log from coverage_logs
        union all select run_id, 'py', py_log from coverage_logs)),
log_values as (
  select run_id, tool, line_no, 'first' as rule,
         {_percent(_words('line') + "[list_position(" + _words('line') + ", 'coverage:') + 1]")} as pct
  from log_lines where tool = 'go' and list_contains({_words('line')}, 'coverage:')
  union all
  select run_id, tool, line_no, 'total', {_percent(_words('line') + '[3]')}
  from log_lines where tool = 'go' and {_trim('line')} like 'total:%'
  union all
  select run_id, tool, line_no, 'js', {_percent(_words('line') + '[10]')}
  from log_lines where tool = 'js' and line like '%All files%'
  union all
  select run_id, tool, line_no, 'py', {_percent(_words('line') + '[4]')}
  from log_lines where tool = 'py' and line like '%TOTAL%'),
log_percents as (
  select r.run_id, r.project_type,
         coalesce(min_by(v.pct, line_no) filter (where rule = 'first' and v.pct is not null), 0.0) as go_first,
         coalesce(max_by(v.pct, line_no) filter (where rule = 'total' and v.pct is not null), 0.0) as go_total,
         coalesce(min_by(v.pct, line_no) filter (where rule = 'js'), 0.0) as js,
         coalesce(min_by(v.pct, line_no) filter (where rule = 'py'), 0.0) as py
  from coverage_logs r left join log_values v using (run_id) group by r.run_id, r.project_type),
type_percents as (
  select run_id, project_type, case project_type when 'go' then case when go_first = 0 then go_total else go_first end
         when 'python' then py when 'javascript' then js end as pct from log_percents)""",
    ),
    "coverage_json": (
        ("coverage_runs",),
        f"""coverage_json as (
  select run_id, case run_id % 3 when 0 then 'cache' when 1 then 'python' else 'javascript' end as tool,
         case run_id % 3 when 0 then '{{"coverage": ' || {_PCT_TEXT} || '}}'
           when 1 then '{{"totals": {{"percent_covered": ' || {_PCT_TEXT} || '}}}}'
           else '{{"total": {{"lines": {{"pct": ' || {_PCT_TEXT} || '}}}}}}' end as body
  from coverage_runs),
json_percents as (
  select run_id, tool, cast(case tool when 'cache' then json_extract_string(body, '$.coverage')
    when 'python' then json_extract_string(body, '$.totals.percent_covered')
    else json_extract_string(body, '$.total.lines.pct') end as double) as pct
  from coverage_json)""",
    ),
    "with_baseline": (
        ("coverage_runs",),
        """with_baseline as (
  select * from (
    select *, last_value(case when kind = 'baseline' then pct end ignore nulls) over (
        partition by repo_key order by ts, run_id rows between unbounded preceding and 1 preceding) as earlier
    from coverage_runs) where kind = 'pr')""",
    ),
    "report": (
        ("with_baseline", "pr_files", "modified_symbols"),
        f"""line_totals as (
  select repo, pr_id, cast(sum(lines_changed) as bigint) as total from pr_files
  where status in ('M', 'A') group by repo, pr_id),
symbol_totals as (
  select repo, pr_id, count(*) as n from modified_symbols group by repo, pr_id),
report as (
  select repo, pr_id, ts, coalesce(earlier, pct) as coverage_before, pct as coverage_after,
         pct - coalesce(earlier, pct) as coverage_delta,
         case when coalesce(n, 0) > 0 then cast(floor(cast(coalesce(total, 0) as double) * cast(0.7 as double)) as bigint)
              else 0 end as new_lines_covered,
         coalesce(total, 0) as new_lines_total, cast(80.0 as double) as coverage_target, pct >= 80.0 as target_met
  from with_baseline left join line_totals using (repo, pr_id) left join symbol_totals using (repo, pr_id))""",
    ),
    "answers": (
        (),
        f"""answers as (
  select conv_id, turn, {_repo('conv_id')} as repo,
         json_object('content', json_array(
             json_object('type', 'text', 'text', text), json_object('type', 'note', 'text', 'skip'),
             json_object('type', 'text', 'text',
               {NL} || '```go' || {NL} || 'x := ' || {_text('turn')} || {NL} || '```' || {NL})),
           'usage', json_object('input_tokens', length(text), 'output_tokens', length(text) * 2)) as body
  from conversations where role = 'assistant'),
answer_blocks as (
  select conv_id, turn, pos, json_extract_string(block, '$.type') as type, json_extract_string(block, '$.text') as text
  from (select conv_id, turn, unnest(cast(body->'$.content' as json[])) as block,
               generate_subscripts(cast(body->'$.content' as json[]), 1) as pos from answers)),
answer_texts as (
  select conv_id, turn, string_agg(text, '' order by pos) filter (where type = 'text') as answer,
         min_by(text, pos) as first_answer from answer_blocks group by conv_id, turn)""",
    ),
}


def _sql(body: str, *needed: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for dependency in CTES[name][0]:
            add(dependency)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    head = "with recursive " + ",\n".join(CTES[n][1] for n in order) + "\n" if order else ""
    return head + body.strip()


def _symbol_query(columns: str, condition: str) -> str:
    return _sql(f"select {columns} from symbols where {condition}", "symbols")


def _suite_paths() -> str:
    return f"""(
  select repo, path from code_files
  union all select repo, {_beside('path')} from code_files
  union all select repo, {_functional_name(_stem('path'), _test_language('path'))} from code_files) as suite"""


def _stats(keys: str, symbols: str = "modified_symbols") -> str:
    return f"""
select {keys}, files_processed,
       cast(coalesce(n_functions, 0) + coalesce(n_classes, 0) + coalesce(n_modules, 0) as bigint) as unit_tests_generated,
       cast(coalesce(n_functional, 0) as bigint) as functional_tests_generated,
       cast(coalesce(n_cases, 0) + coalesce(n_functional, 0) + coalesce(n_modules, 0) as bigint) as total_test_cases
from (select {keys}, count(*) filter (where status like 'M%') as files_processed
      from change_rows group by {keys})
left join (select {keys}, count(*) filter (where kind = 'function') as n_functions,
                  count(*) filter (where kind = 'class') as n_classes,
                  count(*) filter (where kind = 'class' and language = 'go') as n_functional,
                  sum(case when kind = 'function' then 3 else n_methods end) as n_cases
           from {symbols} group by {keys}) using ({keys})
left join (select {keys}, count(*) as n_modules
           from (select distinct {keys}, module from modified_modules) group by {keys}) using ({keys})"""


_INTEGRATION = """
select repo, count(*) filter (where d.path is null) as files_integrated,
       count(*) filter (where d.path is not null) as duplicates_skipped,
       cast(sum(case when d.path is null then coalesce(n_new, 0) else 0 end) as bigint) as tests_added
from generated_files g left join duplicates d using (repo, path) left join additions a using (repo, path)
group by repo"""


def _merged(skip: bool) -> str:
    duplicate = "when d.path is not null then 'skipped'" if skip else ""
    return f"""
select repo, path, action, md5(case action when 'copied' then source
    when 'merged' then target || case when added is null then '' else {_lit(SEPARATOR)} || added end
    else target end) as content_md5
from (select p.repo, p.path, source, target, added,
             case when source is null then 'kept' when target is null then 'copied' {duplicate} else 'merged' end as action
      from pairs p left join duplicates d on p.repo = d.repo and p.path = d.path
      left join additions a on p.repo = a.repo and p.path = a.path)"""


_MARKERS = (
    "(case doc_id % 10 when 0 then 'go.mod' when 1 then 'setup.py' when 2 then 'package.json' "
    "when 3 then 'pyproject.toml' else 'README.md' end)"
)


def _project(rules: str) -> str:
    order = fixed.PROJECT_MARKERS if rules == "marker" else fixed.PATH_RULE_MARKERS
    branches = " ".join(
        f"when bool_or(path = {_lit(name)}) then {_lit(kind)}" for name, kind in order
    )
    return f"case {branches} else 'unknown' end"


_CACHE = """
select q.event_id as request_id, coalesce(hit_ts >= q.ts - interval 24 hour, false) as is_hit,
       case when hit_ts >= q.ts - interval 24 hour then hit else '' end as answer
from (select event_id, ts, props from events where event_type = 'view') q
asof left join (select ts as hit_ts, props, 'answer ' || cast(event_id as varchar) as hit
                from events where event_type = 'purchase') a
  on q.props = a.props and q.ts >= a.hit_ts"""

_SHOWN = "coverage_before, coverage_after, coverage_delta, coverage_target, target_met"
_DISPLAYED = (
    "printf('Before: %.2f%%', coverage_before) || chr(10) || printf('After:  %.2f%%', coverage_after) || chr(10) || "
    "printf('Change: %+.2f%%', coverage_delta) || chr(10) || "
    "printf('New lines covered: %d/%d', new_lines_covered, new_lines_total) || chr(10) || "
    "printf('Target: %.2f%% ', coverage_target) || case when target_met then '(met)' else '(not met)' end"
)


_PATCH_LINES = f"""
select c.repo, c.pr_id, c.path, c.status, {_language('c.path')} as language,
       coalesce(n_changed, 0) as lines_changed, coalesce(n_added, 0) as lines_added, md5(coalesce(diff, '')) as diff_md5
from change_rows c left join patches p on c.repo = p.repo and c.pr_id = p.pr_id and c.path = p.path
left join (select path, count(*) filter (where (line like '+%' and line not like '+++%')
                                            or (line like '-%' and line not like '---%')) as n_changed,
                  count(*) filter (where line like '+%' and line not like '+++%') as n_added
           from (select path, unnest(string_split(diff, {NL})) as line from patches) group by path) n
  on c.path = n.path
where substr(c.status, 1, 1) in ('M', 'A', 'D')"""

_PLAN = f"""
select repo, pr_id, path, symbol, name, description, case_type, {_flat_name('path', 'language')} as test_path,
       md5(code) as code_md5
from unit_cases semi join (select repo, path from change_rows where status like 'M%') using (repo, path)
union all
select repo, pr_id, path, symbol, name, description, case_type, test_path, md5(code) from functional_cases
union all
select repo, pr_id, '', symbol, name, description, case_type, test_path, md5(code) from integration_cases"""

_RUN_SUMMARY = f"""
select repo, coalesce(files_processed, 0) as files_processed, coalesce(unit_tests_generated, 0) as unit_tests_generated,
       coalesce(functional_tests_generated, 0) as functional_tests_generated,
       coalesce(total_test_cases, 0) as total_test_cases,
       coalesce(files_integrated, 0) as files_integrated, coalesce(duplicates_skipped, 0) as duplicates_skipped,
       coalesce(tests_added, 0) as tests_added, pr_url
from ({_stats('repo')}) full join ({_INTEGRATION}) using (repo)
left join (select repo, max_by(pr_url, (created_at, pr_id)) as pr_url from pull_requests group by repo) using (repo)"""


def statements() -> dict[str, str]:
    """One statement per driver query."""
    include, exclude = glob_regex(CONFIG.include_globs), glob_regex(CONFIG.exclude_globs)
    endings = "|".join(fixed.TEST_NAME_ENDINGS)
    path_line = f"string_split(content, {NL})[1]"
    return {
        # Changes
        "change_report": _sql(
            f"""
select repo, coalesce({_module('path')}, '') as module, {_language('path')} as language,
       count(*) filter (where status = 'M') as files_modified, count(*) filter (where status = 'A') as files_added,
       count(*) filter (where status = 'D') as files_deleted, cast(sum(lines_added) as bigint) as lines_added,
       cast(sum(lines_removed) as bigint) as lines_removed,
       cast(sum(lines_added + lines_removed) as bigint) as lines_changed
from snapshot_status join snapshot_lines using (repo, path) group by 1, 2, 3""",
            "snapshot_lines",
        ),
        "snapshot_status": _sql("select repo, path, status from snapshot_status", "snapshot_status"),
        "snapshot_lines": _sql("select repo, path, lines_added, lines_removed from snapshot_lines", "snapshot_lines"),
        "snapshot_hunks": _sql(
            "select repo, path, base_start, base_lines, head_start, head_lines from snapshot_hunks", "snapshot_hunks"
        ),
        "snapshot_renames": _sql(
            "select repo, path, status, old_path, similarity from snapshot_renames", "snapshot_renames"
        ),
        "hunk_line_counts": _sql(
            "select repo, path, cast(sum(head_lines) as bigint) as lines_added, "
            "cast(sum(base_lines) as bigint) as lines_removed from snapshot_hunks group by repo, path",
            "snapshot_hunks",
        ),
        "covered_lines": _sql(
            oracle_lines.covered("new_line_numbers", "repo, path"), "hunk_lines", "profile_lines"
        ),
        "request_coverage": _sql(
            f"""
select repo, pr_id, coalesce(n_covered, estimate) as new_lines_covered, estimate as new_lines_covered_est,
       coalesce(n_known, total) as new_lines_measured, total as new_lines_total, n_known is not null as from_data
from (select repo, pr_id, total, case when coalesce(n, 0) > 0
        then cast(floor(cast(total as double) * cast(0.7 as double)) as bigint) else 0 end as estimate
      from (select repo, pr_id, cast(sum(lines_changed) as bigint) as total
            from ({_PATCH_LINES}) where substr(status, 1, 1) in ('M', 'A') group by repo, pr_id)
      left join (select repo, pr_id, count(*) as n from modified_symbols group by repo, pr_id) using (repo, pr_id))
left join (select repo, pr_id, cast(sum(n_covered) as bigint) as n_covered, cast(sum(n_known) as bigint) as n_known
           from ({oracle_lines.covered("patch_numbers", "repo, pr_id, path")}) where has_data group by repo, pr_id)
  using (repo, pr_id)""",
            "patch_numbers",
            "profile_lines",
            "patches",
            "modified_symbols",
        ),
        "name_status_files": _sql(
            "select doc_id, repo, status, substr(status, 1, 1) as status_class, path from change_rows "
            "where substr(status, 1, 1) in ('M', 'A', 'D')",
            "change_rows",
        ),
        "change_list_scan": _sql("select repo, status, path from change_rows", "change_rows"),
        "changed_file_counts": _sql(
            "select repo, pr_id, count(*) as n_files from change_rows where path <> '' group by repo, pr_id",
            "change_rows",
        ),
        "patch_lines": _sql(_PATCH_LINES, "change_rows", "patches"),
        "status_counts": _sql(
            """
select repo, pr_id, count(*) filter (where status = 'M') as files_modified,
       count(*) filter (where status = 'A') as files_added, count(*) filter (where status = 'D') as files_deleted
from pr_files group by repo, pr_id""",
            "pr_files",
        ),
        "new_lines": _sql(
            "select repo, pr_id, cast(sum(lines_changed) as bigint) as new_lines_total from pr_files "
            "where status in ('M', 'A') group by repo, pr_id",
            "pr_files",
        ),
        "languages": _sql(f"select path, {_language('path')} as language from code_files", "code_files"),
        "languages_short": _sql(
            f"select path, {_test_language('path')} as language, {_language_ext(_test_language('path'))} as extension "
            "from code_files",
            "code_files",
        ),
        "languages_display": _sql(f"select path, {_display('path')} as language from code_files", "code_files"),
        "analyzable_files": _sql(
            f"select doc_id, path from change_rows where status like 'M%' "
            f"and lower({_ext('path')}) in ('.go', '.py', '.js', '.ts', '.java')",
            "change_rows",
        ),
        "modules": _sql(
            f"select distinct repo, {_module('path')} as module from code_files where {_module('path')} is not null",
            "code_files",
        ),
        "preview_files": _sql(
            """
select repo, pr_id, rank, path, status, greatest(n - 10, 0) as n_more
from (select *, row_number() over (partition by repo, pr_id order by seq, path, status, lines_changed) as rank,
             count(*) over (partition by repo, pr_id) as n from pr_files) where rank <= 10""",
            "pr_files",
        ),
        # Symbols
        "py_functions": _symbol_query("repo, path, name", "language = 'python' and kind = 'function'"),
        "py_classes": _symbol_query("repo, path, name", "language = 'python' and kind = 'class'"),
        "js_functions": _symbol_query(
            "repo, path, language, name", "language in ('javascript', 'typescript') and kind = 'function'"
        ),
        "js_classes": _symbol_query(
            "repo, path, language, name", "language in ('javascript', 'typescript') and kind = 'class'"
        ),
        "go_functions": _symbol_query("repo, path, name, line", "language = 'go' and kind = 'function'"),
        "go_args": _sql(
            """
select path, name as function, pos - 1 as pos, arg
from (select path, name, unnest(string_split(args, ',')) as arg,
             generate_subscripts(string_split(args, ','), 1) as pos
      from symbols where language = 'go' and kind = 'function' and args <> '')""",
            "symbols",
        ),
        "nested_declarations": f"""
select doc_id, kind, replace(name, '{{id}}', {_text('doc_id')}) as name, cast(line as bigint) as line, args,
       replace(methods, '{{id}}', {_text('doc_id')}) as methods
from documents, (values {', '.join(str(d) for d in NESTED_DECLARATIONS)}) as d(kind, name, line, args, methods)""".strip(),
        "go_structs": _symbol_query("repo, path, name, line", "language = 'go' and kind = 'class'"),
        "struct_methods": _symbol_query("path, name, methods", "language = 'go' and kind = 'class'"),
        "symbols_all": _symbol_query(
            "repo, pr_id, path, language, kind, type, name, line, args, methods, ord", "true"
        ),
        "semantic_changes": _sql(
            """
select repo, pr_id, case when kind = 'function' then 'function_modified' else 'struct_modified' end as type,
       name, path as file, case when kind = 'function' then 'medium' else 'high' end as impact
from modified_symbols where language = 'go'""",
            "modified_symbols",
        ),
        "high_impact": _sql(
            "select repo, pr_id, 'struct_modified' as type, name, path as file, 'high' as impact "
            "from modified_symbols where language = 'go' and kind = 'class'",
            "modified_symbols",
        ),
        "symbol_frameworks": _symbol_query(
            f"path, kind, name, language, {_framework('language', True)} as framework", "true"
        ),
        "file_frameworks": _sql(
            f"select path, {_language('path')} as language, {_framework(_language('path'), True)} as framework "
            "from code_files",
            "code_files",
        ),
        "symbol_sources": _sql(
            "select repo, path, kind, name, md5(content) as source_md5 from symbols "
            "join (select repo, path, content from code_files) using (repo, path)",
            "symbols",
        ),
        # Test planning
        "test_plan": _sql(_PLAN, "unit_cases", "functional_cases", "integration_cases"),
        "test_plan_no_edges": _sql(
            "select path, symbol, name, case_type from unit_cases where case_type <> 'edge_case'", "unit_cases"
        ),
        "test_plan_stats": _sql(_stats("repo, pr_id"), "modified_symbols", "modified_modules"),
        "test_paths_flat": _sql(
            f"""
select path, {_flat_name('path', _language('path'))} as unit_name,
       {_functional_name(_stem('path'), _test_language('path'))} as functional_name,
       'test_' || coalesce({_module('path')}, 'root') || '_integration_test.go' as integration_name
from code_files""",
            "code_files",
        ),
        "test_paths_beside": _sql(
            f"select path, {_beside('path')} as unit_path, 'functional/' || {_beside('path')} as functional_path "
            "from code_files",
            "code_files",
        ),
        "test_files": _sql(
            "select repo, pr_id, path, test_path, n_cases, md5(content) as content_md5 from unit_files", "unit_files"
        ),
        "test_files_last_writer": _sql(
            f"""
select repo, test_path, w.name as symbol, count(c.name) as n_cases,
       md5({_by_language('w.language', templates.HEADER, framework=_framework('w.language'))} || {NL} || {NL}
         || coalesce(string_agg((case when w.language = 'python' then '#' else '//' end) || ' ' || c.description
              || {NL} || c.code || {NL} || {NL}, '' order by case_ord), '')) as content_md5
from (select *, row_number() over (partition by repo, test_path order by late desc, path desc, ord desc) as rn
      from (select *, {_flat_name('path', 'language')} as test_path from symbols)) w
left join unit_cases c on w.repo = c.repo and w.path = c.path and w.ord = c.ord
where rn = 1 group by w.repo, test_path, w.name, w.language""".replace("select repo, test_path", "select w.repo, test_path", 1),
            "unit_cases",
        ),
        "single_case_files": _sql(
            f"""
select distinct repo, pr_id, test_path, md5({_lit(templates.FUNCTIONAL_HEADER)} || {NL} || {NL} || '// ' || description
       || {NL} || code || {NL} || {NL}) as content_md5 from functional_cases
union all
select distinct repo, pr_id, test_path, md5({_fill(templates.HEADER['go'], framework="'testing'")} || {NL} || {NL}
       || '// ' || description || {NL} || code || {NL} || {NL}) from integration_cases""",
            "functional_cases",
            "integration_cases",
        ),
        "prompts": _sql(
            f"""
select repo, path, name, md5({_fill(templates.FUNCTION_PROMPT, name='name', language='language', source='content')})
  as prompt_md5
from symbols join (select repo, path, content from code_files) using (repo, path) where kind = 'function'""",
            "symbols",
        ),
        "file_prompts": _sql(
            f"""
select repo, path, md5({_fill(templates.FILE_PROMPT, kind="'unit'", path='path', language=_display('path'),
                              extension=_last_dot('path'), source='content')}) as prompt_md5
from code_files""",
            "code_files",
        ),
        "path_rules": _sql(
            f"""
select repo, path, regexp_matches(path, '{fixed.FUNCTIONAL_CANDIDATES}') as wants_functional
from code_files where not regexp_matches(path, '{fixed.SKIPPED_PATHS}')""",
            "code_files",
        ),
        "page_path_rules": f"""
select page_id, path, regexp_matches(path, '{fixed.FUNCTIONAL_CANDIDATES}') as wants_functional
from (select page_id, regexp_replace(url, '^https?://[^/]*/', '') as path from pages)
where not regexp_matches(path, '{fixed.SKIPPED_PATHS}')""".strip(),
        "names_by_pattern": _symbol_query(
            "path, kind, name, 'test_' || name as unit_name, 'test_' || name || '_e2e' as functional_name", "true"
        ),
        # Test files and deduplication
        "test_file_filter": _sql(
            f"select repo, path from {_suite_paths()} where {_is_test('path')}", "code_files"
        ),
        "functional_files": _sql(
            f"select repo, path from {_suite_paths()} where contains({_base('path')}, 'functional')", "code_files"
        ),
        "test_file_count": _sql(
            f"""
select repo, count(*) filter (where {_base('path')} like '%\\_test.%' escape '\\'
           or {_base('path')} like 'test\\_%.%' escape '\\' or {_base('path')} like '%.test.%') as n_test_files,
       count(*) filter (where {_base('path')} like '%test%') as n_mentioning_test
from {_suite_paths()} group by repo""",
            "code_files",
        ),
        "test_names": _sql("select repo, path, test_name from existing_names", "existing_names"),
        "test_blocks": _sql(
            "select repo, path, block_no, test_name, md5(block) as block_md5 from suite_named", "suite_blocks"
        ),
        "test_blocks_unindented": _sql(
            "select repo, path, block_no, test_name, md5(block) as block_md5 from whole_named", "whole_blocks"
        ),
        "matched_paths": _sql(
            "select repo, g.path, e.path is not null as path_exists from generated_files g "
            "left join existing_tests e using (repo, path)".replace("g.path,", "path,"),
            "generated_files",
            "existing_tests",
        ),
        "duplicate_files": _sql("select repo, path from duplicates", "pairs"),
        "new_tests": _sql(
            """
select repo, path, name from generated_tests g where not exists (
  select 1 from existing_tests e where e.repo = g.repo and e.path = g.path and contains(e.content, g.name))""",
            "generated_tests",
            "existing_tests",
        ),
        "new_tests_exact": _sql(
            "select repo, path, name from generated_tests "
            "anti join (select repo, path, test_name as name from existing_names) using (repo, path, name)",
            "generated_tests",
            "existing_names",
        ),
        "test_name_difference": _sql(
            "select repo, path, name from generated_tests except all select repo, path, test_name from existing_names",
            "generated_tests",
            "existing_names",
        ),
        "integration_stats": _sql(_INTEGRATION, "pairs"),
        "merged_files": _sql(_merged(True), "pairs"),
        "merged_files_per_test": _sql(_merged(False), "pairs"),
        "obsolete_tests": _sql(
            f"""
select repo, test_name
from (select *, regexp_extract(test_name, '^(?:Test|test_)(.+)$', 1) as whole,
             regexp_extract(test_name, '^(?:Test|test_)(.+?)(?:{endings})$', 1) as stem,
             regexp_extract(test_name, '^(?:Test|test_)(.+)_[^_]*$', 1) as owner from existing_names) t
where whole <> ''
  and not exists (select 1 from head_symbols h where h.repo = t.repo and {_cap('h.name')} = {_cap('whole')})
  and not exists (select 1 from head_symbols h where h.repo = t.repo and {_cap('h.name')} = {_cap('stem')})
  and not exists (select 1 from head_symbols h where h.repo = t.repo and {_cap('h.name')} = {_cap('owner')})""",
            "existing_names",
            "head_symbols",
        ),
        "unreached_tests": _sql(
            f"""
select distinct repo, caller as test_name from test_calls e
where regexp_matches(caller, '^(Test|test_)')
  and not exists (select 1 from alive_functions a where a.repo = e.repo and a.name = e.caller)""",
            "test_calls",
        ),
        "run_summary": _sql(_RUN_SUMMARY, "modified_symbols", "modified_modules", "pairs", "pull_requests"),
        # Coverage
        "coverage_from_log": _sql("select run_id, go_first as pct from log_percents", "log_percents"),
        "coverage_total": _sql("select run_id, go_total as pct from log_percents", "log_percents"),
        "coverage_js": _sql("select run_id, js as pct from log_percents", "log_percents"),
        "coverage_py": _sql("select run_id, py as pct from log_percents", "log_percents"),
        "coverage_by_type": _sql(
            "select run_id, project_type, coalesce(pct, -1.0) as pct from type_percents", "log_percents"
        ),
        "coverage_from_json": _sql("select run_id, tool, pct from json_percents", "coverage_json"),
        "coverage_json_scan": _sql(
            "select tool, pct, count(*) as n_reports from json_percents group by tool, pct", "coverage_json"
        ),
        "project_type": _sql(
            f"""
select repo, {_project('marker')} as project_type, {_project('rules')} as project_type_by_rules
from (select repo, path from code_files union all select repo, {_MARKERS} from code_files) group by repo""",
            "code_files",
        ),
        "coverage_baseline": _sql(
            "select run_id, repo_key, coalesce(earlier, 0.0) as coverage_before from with_baseline", "with_baseline"
        ),
        "coverage_report": _sql(
            f"""
select repo, pr_id, cast(ts as varchar) as ts, coverage_before, coverage_after, coverage_delta, new_lines_covered,
       new_lines_covered as new_lines_covered_est, new_lines_total, coverage_target, target_met from report""",
            "report",
        ),
        "before_after": _sql(
            f"""
select repo, pr_id, coalesce(b.pct, a.pct, 0.0) as coverage_before,
       coalesce(a.pct, b.pct, 0.0) as coverage_after,
       coalesce(a.pct, b.pct, 0.0) - coalesce(b.pct, a.pct, 0.0) as coverage_delta
from (select {_repo('run_id')} as repo, run_id as pr_id, pct from type_percents
      join (select run_id, kind from coverage_runs) using (run_id) where kind = 'baseline') b
full join (select {_repo('run_id')} as repo, run_id as pr_id, pct from json_percents) a using (repo, pr_id)""",
            "log_percents",
            "coverage_json",
        ),
        "coverage_summary": _sql(
            f"""
select repo, pr_id, {_DISPLAYED} as summary,
       coalesce('Functional tests: #' || cast(p.pr_id + 1 as varchar), 'No functional tests') as link_line
from report r left join pull_requests p using (repo, pr_id)""",
            "report",
            "pull_requests",
        ),
        "gates": _sql(
            """
select repo, pr_id, coverage_delta >= 0 as decrease_ok, coverage_delta >= 1.0 as increase_ok,
       round(greatest(coverage_target - coverage_after, 0.0), 4) as shortfall from report""",
            "report",
        ),
        "project_thresholds": _sql(
            """
select repo, pr_id, threshold as coverage_target, coverage_after >= threshold as target_met
from report join (select repo, cast(60 + max(pr_id) % 30 as double) as threshold from pull_requests group by repo)
  using (repo)""",
            "report",
            "pull_requests",
        ),
        "comment_body": _sql(
            f"""
select repo, pr_id, 'Unit tests: ' || cast(coalesce(unit_tests_generated, 0) as varchar)
       || chr(10) || 'Functional tests: ' || cast(coalesce(functional_tests_generated, 0) as varchar)
       || chr(10) || printf('Coverage: %.2f%% to %.2f%% (%+.2f%%)', coverage_before, coverage_after, coverage_delta)
       as body
from report left join ({_stats("repo, pr_id")}) using (repo, pr_id)""",
            "report",
            "modified_symbols",
            "modified_modules",
        ),
        "metrics_rollup": _sql(
            f"""
select coalesce(repo, '') as repo, coalesce(module, '') as module, grouping(repo, module) as level,
       count(*) as n_files, cast(sum(lines_changed) as bigint) as lines_changed
from (select repo, {_module('path')} as module, lines_changed from pr_files) group by rollup (repo, module)""",
            "pr_files",
        ),
        "tests_per_request": _sql(
            f"""
select coalesce(repo, '') as repo, coalesce(pr_id, '') as pr_id, grouping(repo, pr_id) as level,
       cast(sum(n) as bigint) as n_cases, count(*) as n_test_files
from (select repo, cast(pr_id as varchar) as pr_id, test_path, count(*) as n from ({_PLAN}) group by 1, 2, 3)
group by rollup (repo, pr_id)""",
            "unit_cases",
            "functional_cases",
            "integration_cases",
        ),
        "generation_metrics": """
select user_id as repo_key, count(*) as n_attempts, avg(cast(round(value * 100) as bigint)) as mean_duration,
       count(*) filter (where event_type <> 'error') / count(*) as success_rate
from events group by user_id""".strip(),
        "coverage_trend": _sql(
            """
select repo_key, run_id, coalesce(round(pct - lag(pct) over (partition by repo_key order by ts, run_id), 4), 0.0)
       as improvement from coverage_runs""",
            "coverage_runs",
        ),
        # Rules
        "generation_rules": _sql(
            f"""
select repo, pr_id, cast(seq as bigint) as seq, path, lines_changed from pr_files
where lines_changed >= 5 and regexp_matches(path, {_lit(include)}) and not regexp_matches(path, {_lit(exclude)})""",
            "pr_files",
        ),
        "capped_cases": _sql("select path, symbol, name from unit_cases where case_ord < 2", "unit_cases"),
        # Responses
        "response_text": _sql("select conv_id, turn, answer, first_answer from answer_texts", "answers"),
        "response_code": _sql(
            f"""
select conv_id, turn, array_to_string(regexp_extract_all(answer, {_lit(_FENCED)}, 1), {NL}) as code
from answer_texts""",
            "answers",
        ),
        "fenced_documents": f"""
select doc_id, md5(array_to_string(regexp_extract_all(r, {_lit(_FENCED)}, 1), {NL})) as code_md5
from (select doc_id, 'Here it is' || {NL} || '```text' || {NL} || text || {NL} || '```' || {NL} || 'Done' as r
      from documents)""".strip(),
        "response_tokens": _sql(
            """
select repo, count(*) as n_responses,
       cast(sum(cast(json_extract_string(body, '$.usage.input_tokens') as bigint)) as bigint) as input_tokens,
       cast(sum(cast(json_extract_string(body, '$.usage.output_tokens') as bigint)) as bigint) as output_tokens
from answers group by repo""",
            "answers",
        ),
        "enhanced_cases": _sql(
            f"""
select repo, pr_id, path, 'Test' || {_cap('name')} || '_Enhanced' as name, 'Enhanced test for ' || name as description,
       'enhanced' as case_type, md5(answer) as code_md5
from symbols join (select 'load_' || cast(conv_id as varchar) as name, min_by(answer, turn) as answer
                   from answer_texts group by conv_id) using (name)
where kind = 'function'""",
            "symbols",
            "answers",
        ),
        "response_cache": _CACHE.strip(),
        "retries": """
select user_id as request_id, count(*) as n_attempts, count(*) filter (where event_type = 'error') as n_failed,
       count(*) filter (where event_type = 'error') between 1 and 2 and bool_and(event_type = 'error') as may_retry
from events group by user_id""".strip(),
        # Scalars
        "repo_urls": f"""
select page_id, {_trim('url')} as https_url,
       'https://' || regexp_extract(url, '^https?://([^/]+)/', 1) || '/'
         || regexp_replace(url, '^https?://[^/]+/', '') as from_ssh
from pages""".strip(),
        "scalar_strings": _sql(
            f"""
select doc_id, {_cap(_base('path'))} as capitalized, starts_with(path, 'src') as has_prefix,
       ends_with(path, '.go') as has_suffix, contains(path, '/f1') as has_part,
       case when contains(path, '/') then substr(path, strpos(path, '/') + 1) else '' end as rest,
       len({_words('line')}) as n_fields, {_trim('line')} as trimmed,
       regexp_replace(path, '\\.go$', '') as no_suffix, regexp_replace(path, '^src', '') as no_prefix,
       case when contains(path, '/') then regexp_extract(path, '^([^/]*)/', 1) || ':' || substr(path, strpos(path, '/') + 1)
            else path end as first_replaced,
       upper({_ext('path')}) as upper_ext, lower({_stem('path')}) as lower_stem, {_dir('path')} as dir,
       {_dir('path')} || '/' || {_base('path')} as joined
from (select doc_id, path, {path_line} as line from code_files) where {_trim('line')} <> ''""",
            "code_files",
        ),
        "scalar_regex_lines": _sql(
            f"""
select doc_id, count(*) as n_lines, min(pos) as first_line, max(pos) as last_line,
       cast(sum(len(regexp_extract_all(line, '(\\w+)\\s+(\\w+)', 2))) as bigint) as n_pairs
from (select doc_id, unnest(string_split(content, {NL})) as line,
             generate_subscripts(string_split(content, {NL}), 1) as pos from code_files)
where regexp_matches(line, '^[A-Z]\\w*\\s') group by doc_id""",
            "code_files",
        ),
        "scalar_numbers_time": """
select o_orderkey, cast(cast(o_totalprice as decimal(20,2)) as double) as parsed, cast(-1 as double) as unparsed,
       cast(floor(cast(o_orderkey as double) * cast(0.7 as double)) as bigint) as truncated,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as rfc3339,
       cast(epoch(o_orderdate) as bigint) as unix_seconds,
       o_orderstatus || ' ' || cast(o_orderkey as varchar) || printf(' %.2f %+.2f', o_totalprice, o_totalprice)
         as formatted
from orders""".strip(),
        "scalar_collections": _sql(
            f"""
select doc_id, {_case(_language('path'), fixed.FRAMEWORKS, "'none'")} as framework,
       len(string_split(path, '/')) + 1 as n_parts, string_split(path, '/')[1] as first_part, path as json_path,
       {_language('path')} as json_language from code_files""",
            "code_files",
        ),
        # Sources and sinks
        "small_files": _sql("select repo, pr_id, path, md5(content) as content_md5 from code_files", "code_files"),
        "source_files": _sql("select repo, path, md5(content) as content_md5 from code_files", "code_files"),
        "test_dir_files": _sql(
            f"select repo, test_path as path, md5(content) as content_md5 from unit_files where {_is_test('test_path')}",
            "unit_files",
        ),
        "report_sink": _sql(f"select repo, pr_id, {_SHOWN} from report", "report"),
        "change_sink": _sql(
            f"select repo, pr_id, path, status, language, lines_changed, diff_md5 from ({_PATCH_LINES})",
            "change_rows",
            "patches",
        ),
        "summary_sink": _sql(
            "select repo, files_processed, unit_tests_generated, total_test_cases, files_integrated, "
            f"duplicates_skipped from ({_RUN_SUMMARY})",
            "modified_symbols",
            "modified_modules",
            "pairs",
            "pull_requests",
        ),
        "test_file_sink": _sql("select repo, test_path as path, md5(content) as content_md5 from unit_files", "unit_files"),
        "functional_sink": _sql(
            f"""
select distinct repo, 'tests/auto-generated/' || {_text('pr_id')} || '/' || test_path as path, md5({_lit(templates.FUNCTIONAL_HEADER)} || {NL} || {NL}
       || '// ' || description || {NL} || code || {NL} || {NL}) as content_md5
from functional_cases""",
            "functional_cases",
        ),
        "baseline_sink": _sql(
            "select cast(repo_key as varchar) as repo, max_by(pct, (ts, run_id)) as coverage from coverage_runs "
            "where kind = 'baseline' group by repo_key",
            "coverage_runs",
        ),
        "stored_suite": _sql(
            f"select repo, path, content_md5 from ({_merged(True)})", "pairs"
        ),
        "stored_baselines": _sql(
            "select cast(repo_key as varchar) as repo, max_by(pct, (ts, run_id)) as coverage from coverage_runs "
            "where kind = 'baseline' group by repo_key",
            "coverage_runs",
        ),
        # Streaming
        "run_requests": f"""
select {_repo('user_id')} as repo, user_id % 100 as pr_id, {_text('event_id')} as event_id,
       case event_type when 'signup' then 'opened' when 'purchase' then 'synchronize' else 'reopened' end as kind,
       case when row_number() over (partition by user_id % 10, user_id % 100 order by ts desc, {_text('event_id')} desc) = 1
            then 'run' else 'superseded' end as outcome
from events where event_type in ('signup', 'purchase', 'error')""".strip(),
        "started_analyses": _sql(
            f"""
select * from ({_stats("repo, pr_id")})
semi join (select {_repo('user_id')} as repo, user_id % 100 as pr_id from events
           where event_type in ('signup', 'purchase', 'error')) using (repo, pr_id)""",
            "modified_symbols",
            "modified_modules",
        ),
        "pr_events": """
select event_id, user_id, case event_type when 'signup' then 'opened' when 'purchase' then 'synchronize'
       else 'reopened' end as kind
from events where event_type in ('signup', 'purchase', 'error')""".strip(),
    }
