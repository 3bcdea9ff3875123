"""States and cities as sources write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import title_case
from .rules import collapsed, lookup, trimmed

# Codes of states by name.
STATE_CODES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO",
    "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
    "district of columbia": "DC",
}
# Cities whose name alone tells the state.
CITY_STATES = {
    "san francisco": ("San Francisco", "CA"), "sf": ("San Francisco", "CA"), "new york": ("New York", "NY"),
    "nyc": ("New York", "NY"), "new york city": ("New York", "NY"), "brooklyn": ("Brooklyn", "NY"),
    "boston": ("Boston", "MA"), "cambridge": ("Cambridge", "MA"), "chicago": ("Chicago", "IL"),
    "seattle": ("Seattle", "WA"), "austin": ("Austin", "TX"), "denver": ("Denver", "CO"),
    "los angeles": ("Los Angeles", "CA"), "la": ("Los Angeles", "CA"), "palo alto": ("Palo Alto", "CA"),
    "mountain view": ("Mountain View", "CA"), "menlo park": ("Menlo Park", "CA"), "oakland": ("Oakland", "CA"),
    "san diego": ("San Diego", "CA"), "san jose": ("San Jose", "CA"), "atlanta": ("Atlanta", "GA"),
    "miami": ("Miami", "FL"), "philadelphia": ("Philadelphia", "PA"), "pittsburgh": ("Pittsburgh", "PA"),
    "portland": ("Portland", "OR"), "salt lake city": ("Salt Lake City", "UT"), "nashville": ("Nashville", "TN"),
    "detroit": ("Detroit", "MI"), "houston": ("Houston", "TX"), "dallas": ("Dallas", "TX"),
    "phoenix": ("Phoenix", "AZ"), "washington dc": ("Washington", "DC"),
}


def state_code(raw: Column) -> Column:
    """The two-letter code of a state given by code or name; null for anything else."""
    s = F.regexp_replace(trimmed(raw), r"\.\z", "")
    known = F.upper(s).isin(*STATE_CODES.values())
    return F.when(s.rlike(r"^[A-Za-z]{2}\z") & known, F.upper(s)).otherwise(lookup(F.lower(s), STATE_CODES))


def city_and_state(raw: Column) -> Column:
    """struct<city, state> of a place as directories list it; null for an empty one, no state outside the country."""
    place = collapsed(raw)
    parts = F.filter(F.transform(F.split(place, ","), trimmed), lambda p: p != "")
    low = F.lower(place)
    city, state = (lookup(low, {k: v[i] for k, v in CITY_STATES.items()}) for i in (0, 1))
    several = F.size(parts) >= 2
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(place != "", F.struct(F.when(several, title_case(first)).otherwise(F.coalesce(city, title_case(place))).alias("city"), F.when(several, state_code(second)).otherwise(state).alias("state")))
