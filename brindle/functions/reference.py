"""The function reference: what the dialect offers, and a search over it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, category string, syntax string, description string, related array<string>"
#: Points for a hit in a name (equal, beginning, inside), category, syntax, description and a related name.
POINTS = {"exact": 1000, "prefix": 500, "inside": 200, "category": 100, "syntax": 75, "description": 50, "related": 25}
#: category -> "syntax | description" lines.
_ENTRIES = {
    "Regular Expressions": """regexp_matches(s, pattern) | whether a pattern occurs
regexp_extract(s, pattern, group) | the first match or one of its groups
regexp_replace(s, pattern, new, flags) | replaces the first match, all with flag g
regexp_split_to_array(s, pattern) | parts between matches
regexp_extract_all(s, pattern, group) | all matches""",
    "String": """concat(a, b, ...) | joins texts, nulls count as empty
concat_ws(sep, a, b, ...) | joins texts with a separator
length(s) | number of characters
lower(s) | lower case
upper(s) | upper case
trim(s, chars) | strips both ends
ltrim(s, chars) | strips the beginning
rtrim(s, chars) | strips the end
substring(s, start, n) | part of a text
replace(s, old, new) | replaces a text
split_part(s, sep, n) | the n-th part
string_split(s, sep) | parts between separators
reverse(s) | characters in reverse
left(s, n) | first characters
right(s, n) | last characters
repeat(s, n) | repeats a text
lpad(s, n, fill) | pads at the beginning
rpad(s, n, fill) | pads at the end
position(part IN s) | place of a text, 0 if absent
contains(s, part) | whether a text occurs
starts_with(s, part) | whether it begins so
ends_with(s, part) | whether it ends so""",
    "Aggregate": """count(x) | rows or non-null values
sum(x) | total
avg(x) | mean
min(x) | least value
max(x) | greatest value
string_agg(x, sep ORDER BY y) | joins values of a group
array_agg(x) | list of a group's values
median(x) | middle value
mode(x) | most frequent value
stddev(x) | sample standard deviation
variance(x) | sample variance
arg_min(x, by) | value where another is least
arg_max(x, by) | value where another is greatest
first(x) | first value
last(x) | last value""",
    "Window": """row_number() | number of a row
rank() | rank with gaps
dense_rank() | rank without gaps
lead(x, n, default) | value of a later row
lag(x, n, default) | value of an earlier row
first_value(x) | first value of the frame
last_value(x) | last value of the frame
ntile(n) | n even groups
percent_rank() | relative rank
cume_dist() | share of rows up to this one""",
    "Date/Time": """current_date | today
current_timestamp | now, also now()
date_trunc(part, d) | cut to a unit
date_part(part, d) | a field, also extract
date_diff(part, a, b) | boundaries between two dates
date_add(d, interval) | adds an interval
strftime(d, codes) | formats a date
strptime(s, codes) | reads a date
age(a, b) | months and days between dates
epoch(d) | seconds since 1970, also epoch_ms
make_date(y, m, d) | a date from numbers""",
    "Numeric": """round(x, n) | rounds half away from zero
floor(x) | next lower whole number
ceil(x) | next higher whole number
abs(x) | absolute value
power(x, y) | power
sqrt(x) | square root
log(x) | logarithm to base 10, also ln and log2
mod(x, y) | remainder
greatest(a, b, ...) | greatest argument
least(a, b, ...) | least argument
random() | random number from 0 to 1""",
    "Conditional": """case when c then x else y end | first branch that holds
if(c, x, y) | one of two values
coalesce(a, b, ...) | first non-null argument
nullif(a, b) | null if equal
ifnull(a, b) | b for null""",
    "Type Conversion": """cast(x as type) | conversion, also x::type
try_cast(x as type) | null if it fails
typeof(x) | name of the type""",
    "List": """list_value(a, b, ...) | a list, also [a, b]
unnest(l) | a row for each element
list_concat(a, b) | joins lists
list_element(l, i) | i-th element, also l[i]
list_contains(l, x) | whether an element occurs
list_filter(l, x -> c) | elements that hold a condition
list_transform(l, x -> e) | changes each element
len(l) | number of elements""",
    "JSON": """json_extract(j, path) | part of a document, also ->
json_extract_string(j, path) | the same as text, also ->>
json_array_length(j) | number of elements
json_object(k, v, ...) | a document from pairs
json_array(a, b, ...) | an array""",
    "SQL Syntax": """select | columns of a result
where | filters rows
join | joins tables: inner, left, right, full, cross
group by | groups rows, also group by all
having | filters groups
order by | sorts rows, nulls last
limit | first rows, also offset
with | names subqueries
union | rows of either query, also union all
intersect | rows of both queries
except | rows of the first query only
distinct | each row once, also distinct on
like | pattern match, also ilike
in | one of a list or subquery
between | a range
exists | whether a subquery has rows
insert | adds rows
update | changes rows
delete | removes rows
create table | a new table, also create view
alter table | changes a table
drop table | removes a table
copy | writes a file""",
    "Dialect": """read_csv(path) | a table from CSV files
read_parquet(path) | a table from Parquet files
read_json(path) | a table from JSON files
describe | columns of a table
show tables | tables
using sample | random rows
pivot | values to columns
unpivot | columns to values
qualify | filters by window functions
exclude | leaves out columns of a star
star replace | changes columns of a star
columns(regex) | columns by pattern
asof join | the closest earlier row
generate_series(a, b, step) | numbers up to and with b
range(a, b, step) | numbers below b
struct_pack(a := x, ...) | a struct
struct_extract(s, name) | a field of a struct""",
}


def entries() -> list[tuple[str, str, str, str, list[str]]]:
    out = []
    for category, lines in _ENTRIES.items():
        names = [line.split(" | ")[0].split("(")[0].strip() for line in lines.split("\n")]
        for n, line in zip(names, lines.split("\n")):
            syntax, text = line.split(" | ")
            out.append((n, category, syntax, text, [x for x in names if x != n][:5]))
    return out


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(entries(), SCHEMA)


def search(spark: SparkSession, query: str, max_results: int = 10) -> DataFrame:
    """name, category, syntax, description, score: best hits first."""
    q, c = query.strip().lower(), F.lower
    name = F.when(c("name") == q, POINTS["exact"]).when(c("name").startswith(q), POINTS["prefix"]).when(c("name").contains(q), POINTS["inside"]).otherwise(0)
    score = name
    for col in ("category", "syntax", "description"):
        score = score + F.when(c(col).contains(q), POINTS[col]).otherwise(0)
    score = score + POINTS["related"] * F.size(F.filter("related", lambda r: r.contains(q)))
    return catalogue(spark).withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "name").select("name", "category", "syntax", "description", "score").limit(max_results)


def completions(prefix: str, words: Iterable[str], limit: int = 20) -> list[str]:
    """Words that begin with, then words that hold, a prefix."""
    p = prefix.lower()
    hits = sorted({w for w in words if p in w.lower()}, key=lambda w: (not w.lower().startswith(p), w.lower()))
    return hits[:limit]
