"""Fixed values.

Everything in this file is a constant whose exact value decides whether results are right:
lookup tables, ranges, rule names and message texts. There is no logic here.
"""

# Category aliases (feed label, canonical label). Only the first counts as a
# recognized category.
CATEGORY_ALIASES = [
    ("NOISE - RESIDENTIAL", "NOISE - RESIDENTIAL"),
    ("NOISE RESIDENTIAL", "NOISE - RESIDENTIAL"),
    ("NOISE - COMMERCIAL", "NOISE - COMMERCIAL"),
    ("NOISE COMMERCIAL", "NOISE - COMMERCIAL"),
    ("NOISE - STREET/SIDEWALK", "NOISE - STREET/SIDEWALK"),
    ("NOISE STREET/SIDEWALK", "NOISE - STREET/SIDEWALK"),
    ("HEATING", "HEAT/HOT WATER"),
    ("HEAT/HOT WATER", "HEAT/HOT WATER"),
    ("GENERAL CONSTRUCTION/PLUMBING", "GENERAL CONSTRUCTION"),
    ("GENERAL CONSTRUCTION", "GENERAL CONSTRUCTION"),
    ("NONCONST", "NON-CONSTRUCTION"),
    ("NON-CONSTRUCTION", "NON-CONSTRUCTION"),
    ("STREET CONDITION", "STREET CONDITION"),
    ("ILLEGAL PARKING", "ILLEGAL PARKING"),
    ("BLOCKED DRIVEWAY", "BLOCKED DRIVEWAY"),
    ("WATER SYSTEM", "WATER SYSTEM"),
    ("PLUMBING", "PLUMBING"),
    ("PAINT/PLASTER", "PAINT - PLASTER"),
    ("PAINT - PLASTER", "PAINT - PLASTER"),
    ("UNSANITARY CONDITION", "UNSANITARY CONDITION"),
    ("DIRTY CONDITIONS", "DIRTY CONDITION"),
    ("DIRTY CONDITION", "DIRTY CONDITION"),
    ("SANITATION CONDITION", "SANITATION CONDITION"),
    ("DAMAGED TREE", "DAMAGED TREE"),
    ("ROOT/SEWER/SIDEWALK CONDITION", "ROOT/SEWER/SIDEWALK CONDITION"),
    ("DERELICT VEHICLE", "DERELICT VEHICLE"),
    ("DERELICT VEHICLES", "DERELICT VEHICLE"),
    ("ABANDONED VEHICLE", "DERELICT VEHICLE"),
    ("REQUEST LARGE BULKY ITEM COLLECTION", "BULKY ITEM COLLECTION"),
    ("ELECTRIC", "ELECTRIC"),
    ("DOOR/WINDOW", "DOOR/WINDOW"),
    ("FLOORING/STAIRS", "FLOORING/STAIRS"),
    ("APPLIANCE", "APPLIANCE"),
    ("SAFETY", "SAFETY"),
    ("OUTSIDE BUILDING", "OUTSIDE BUILDING"),
    ("RODENT", "RODENT"),
    ("AIR QUALITY", "AIR QUALITY"),
    ("SEWER", "SEWER"),
    ("TRAFFIC SIGNAL CONDITION", "TRAFFIC SIGNAL CONDITION"),
    ("STREET LIGHT CONDITION", "STREET LIGHT CONDITION"),
    ("GRAFFITI", "GRAFFITI"),
    ("HOMELESS PERSON ASSISTANCE", "HOMELESS PERSON ASSISTANCE"),
    ("ENCAMPMENT", "ENCAMPMENT"),
    ("CONSUMER COMPLAINT", "CONSUMER COMPLAINT"),
    ("FOOD ESTABLISHMENT", "FOOD ESTABLISHMENT"),
    ("INDOOR AIR QUALITY", "INDOOR AIR QUALITY"),
    ("MISSED COLLECTION", "MISSED COLLECTION"),
    ("MISSED COLLECTION (ALL MATERIALS)", "MISSED COLLECTION"),
    ("ILLEGAL DUMPING", "ILLEGAL DUMPING"),
    ("ILLEGAL FIREWORKS", "ILLEGAL FIREWORKS"),
    ("ELEVATOR", "ELEVATOR"),
    ("WATER QUALITY", "WATER QUALITY"),
    ("SIDEWALK CONDITION", "SIDEWALK CONDITION"),
    ("BUILDING/USE", "BUILDING/USE"),
    ("MAINTENANCE OR FACILITY", "MAINTENANCE OR FACILITY"),
    ("NEW TREE REQUEST", "NEW TREE REQUEST"),
    ("TAXI COMPLAINT", "TAXI COMPLAINT"),
    ("FOR HIRE VEHICLE COMPLAINT", "FOR HIRE VEHICLE COMPLAINT"),
    ("ANIMAL ABUSE", "ANIMAL ABUSE"),
    ("ANIMAL-ABUSE", "ANIMAL ABUSE"),
    ("DEAD/DYING TREE", "DEAD/DYING TREE"),
    ("DEAD TREE", "DEAD/DYING TREE"),
]

# Spellings and the borough each one stands for.
BOROUGH_SPELLINGS = [
    ("MANHATTAN", "MANHATTAN"),
    ("NEW YORK", "MANHATTAN"),
    ("NY", "MANHATTAN"),
    ("BRONX", "BRONX"),
    ("THE BRONX", "BRONX"),
    ("BRONX COUNTY", "BRONX"),
    ("BROOKLYN", "BROOKLYN"),
    ("KINGS", "BROOKLYN"),
    ("QUEENS", "QUEENS"),
    ("STATEN ISLAND", "STATEN ISLAND"),
    ("STATEN IS", "STATEN ISLAND"),
    ("RICHMOND", "STATEN ISLAND"),
]

# Address words and the short form used in the address key.
ADDRESS_WORDS = [
    ("NORTH", "N"),
    ("SOUTH", "S"),
    ("EAST", "E"),
    ("WEST", "W"),
    ("NORTHEAST", "NE"),
    ("NORTHWEST", "NW"),
    ("SOUTHEAST", "SE"),
    ("SOUTHWEST", "SW"),
    ("STREET", "ST"),
    ("AVENUE", "AVE"),
    ("AV", "AVE"),
    ("ROAD", "RD"),
    ("BOULEVARD", "BLVD"),
    ("DRIVE", "DR"),
    ("PLACE", "PL"),
    ("COURT", "CT"),
    ("LANE", "LN"),
    ("TERRACE", "TER"),
    ("PARKWAY", "PKWY"),
    ("HIGHWAY", "HWY"),
    ("SQUARE", "SQ"),
    ("CIRCLE", "CIR"),
    ("EXPRESSWAY", "EXPY"),
    ("TURNPIKE", "TPKE"),
    ("PLAZA", "PLZ"),
]

# ZIP ranges (first, last, borough), both ends included.
ZIP_RANGES = [
    (10001, 10286, "MANHATTAN"),
    (10292, 10292, "MANHATTAN"),
    (10301, 10314, "STATEN ISLAND"),
    (10451, 10475, "BRONX"),
    (11004, 11005, "QUEENS"),
    (11101, 11120, "QUEENS"),
    (11201, 11256, "BROOKLYN"),
    (11351, 11436, "QUEENS"),
    (11691, 11697, "QUEENS"),
]

# ZIPs without a single borough, and the boroughs accepted for each.
SHARED_ZIPS = [
    ("10463", ["BRONX", "MANHATTAN"]),
    ("11370", ["QUEENS"]),
]

# City bounding box in degrees (inclusive), zero-coordinate tolerance, Earth radius.
BBOX_MIN_LAT = 40.477
BBOX_MAX_LAT = 40.918
BBOX_MIN_LON = -74.259
BBOX_MAX_LON = -73.700
ZERO_TOLERANCE = 1e-6
EARTH_RADIUS_KM = 6371.0088

# Rule registry in report order (name, severity, detail text).
# {..} marks the parts filled per record.
RULES = [
    ("unique_key_missing", "reject", "unique_key is absent"),
    ("complaint_type_missing", "reject", "complaint_type is absent"),
    ("complaint_type_unrecognized", "observe", "complaint type is not in the known-category table; record kept"),
    ("created_date_missing", "reject", "created_date is absent"),
    ("created_date_future", "flag", "created_date is in the future"),
    ("closed_before_created", "flag", "closed_date precedes created_date by {delta}"),
    ("zip_missing", "flag", "incident_zip is empty"),
    ("zip_malformed", "flag", "incident_zip is not a parseable five-digit ZIP"),
    ("zip_outside_nyc", "flag", "ZIP is well-formed but not allocated to New York City"),
    ("coords_missing", "flag", "latitude and longitude are both absent"),
    ("coords_partial", "flag", "exactly one of latitude/longitude is present"),
    ("coords_null_island", "flag", "coordinates are (0, 0) -- a null sentinel, not a location"),
    ("coords_swapped", "flag", "latitude and longitude appear transposed"),
    ("coords_outside_nyc", "flag", "coordinates fall outside the New York City bounding box"),
    ("borough_zip_conflict", "flag", "borough is {borough} but ZIP {zip} is allocated to {expected}"),
    ("borough_geo_conflict", "flag", "borough is {borough} but the coordinates fall in {found}"),
]

# Tolerances of the date rules.
CLOSE_SKEW = "INTERVAL 1 MINUTE"
FUTURE_SLACK = "INTERVAL 1 HOUR"

# Text fields that are tidied, with lengths for targets of fixed width; texts stay
# whole unless lengths are asked for.
TEXT_LENGTHS = {
    "agency": 32,
    "agency_name": 256,
    "complaint_type": 256,
    "descriptor": 512,
    "status": 64,
    "incident_address": 256,
    "resolution_description": 2000,
}

# Feed fields that may hold the update time, in order of preference.
UPDATE_TIME_FIELDS = (":updated_at", "updated_at", ":updated_at_meta")
