from marquee.functions.entities import (
    NAME_PATTERNS,
    as_records,
    entities,
    entities_status,
    lead_by_pattern,
    names_by_pattern,
    parse_entities,
    read_records,
    status,
)
from marquee.functions.lenient import (
    blank_to_null,
    date_prefix,
    lenient_date,
    lenient_double,
    lenient_long,
    one_line,
    strip_space,
    unquoted,
    year_of_text,
)
from marquee.functions.measures import (
    band,
    capped_bucket,
    fraction,
    passed,
    period_of_date,
    period_of_year,
    positive,
    prorate,
    return_on_investment,
)

__all__ = [
    "NAME_PATTERNS",
    "as_records",
    "band",
    "blank_to_null",
    "capped_bucket",
    "date_prefix",
    "entities",
    "entities_status",
    "fraction",
    "lead_by_pattern",
    "lenient_date",
    "lenient_double",
    "lenient_long",
    "names_by_pattern",
    "one_line",
    "parse_entities",
    "passed",
    "period_of_date",
    "period_of_year",
    "positive",
    "prorate",
    "read_records",
    "return_on_investment",
    "status",
    "strip_space",
    "unquoted",
    "year_of_text",
]
