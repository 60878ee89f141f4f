"""What a listing's text says about price, age, setting and place."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee import vocab
from marquee.functions.text import col, collapse, first_group


def cost_in(text) -> Column:
    t = col(text)
    return (F.when(t.rlike(vocab.COST_FREE), "Free").when(t.rlike(vocab.COST_DONATION), "Donation")
            .when(t.contains("$") & t.rlike(vocab.COST_AMOUNT), F.trim(F.regexp_extract(t, vocab.COST_AMOUNT, 0)))
            .when(t.rlike(vocab.COST_PAID), "Paid"))


def age_in(text) -> Column:
    t = col(text)
    number = F.when(t.rlike(r"\d"), F.coalesce(*[first_group(t, p, 1) for p in vocab.AGE_NUMBER]))
    return F.coalesce(F.concat(number, F.lit("+")), F.when(t.rlike(vocab.AGE_ALL), "All ages").when(
        t.rlike(vocab.AGE_KIDS), "Kids friendly"))


def name_and_details(name, details) -> Column:
    return F.trim(F.concat(F.coalesce(col(name), F.lit("")), F.lit(" "), F.coalesce(col(details), F.lit(""))))


def extract_cost(name, details) -> Column:
    """The name is asked first, then name and details together."""
    return F.coalesce(cost_in(name), cost_in(name_and_details(name, details)))


def extract_age(name, details) -> Column:
    return F.coalesce(age_in(name), age_in(name_and_details(name, details)))


def extract_setting(text) -> Column:
    return F.when(col(text).rlike(vocab.OUTDOOR), "outdoor").when(col(text).rlike(vocab.INDOOR), "indoor")


def extract_address(text) -> Column:
    return F.trim(first_group(text, vocab.STREET_ADDRESS))


def extract_venue(name) -> Column:
    venue = F.trim(first_group(name, vocab.VENUE_AFTER_AT, 1))
    return F.when((F.length(venue) > 2) & ~F.lower(venue).isin("the", "chicago"), venue)


def locality(address) -> Column:
    """The suburb an address is in; null in the city and where the address does not say."""
    cities = F.regexp_extract_all(col(address), F.lit(vocab.CITY_BEFORE_STATE), F.lit(1))
    at_home = collapse(F.lower(F.get(cities, F.lit(0)))).isin(vocab.HOME_CITY)
    last = F.initcap(collapse(F.try_element_at(cities, F.lit(-1))))
    return F.when(~at_home & ~F.lower(last).isin(vocab.HOME_CITY), last)


def enriched(name, details) -> dict[str, Column]:
    """Every column the text can give, by the catalogue's names."""
    full = name_and_details(name, details)
    return {"cost": extract_cost(name, details), "age_range": extract_age(name, details),
            "is_outdoor": extract_setting(full), "address": extract_address(full), "venue_name": extract_venue(name)}


