"""Names of entity types in the sources, by the internal type that they stand for."""

# Type names and URIs of the sources.
PRIMARY = {
    "Settlement": [
        "http://dbpedia.org/ontology/Settlement",
        "http://dbpedia.org/ontology/Town",
        "http://dbpedia.org/ontology/City",
        "http://dbpedia.org/ontology/Village",
        "http://dbpedia.org/ontology/HistoricalSettlement",
        "http://dbpedia.org/ontology/CityDistrict",
        "http://rdf.freebase.com/ns/location.citytown",
        "http://rdf.freebase.com/ns/location.capital_of_administrative_division",
        "http://rdf.freebase.com/ns/location.neighborhood",
        "http://rdf.freebase.com/ns/location.place_with_neighborhoods",
        "http://rdf.freebase.com/ns/location.de_city",
        "http://rdf.freebase.com/ns/location.in_city",
        "http://rdf.freebase.com/ns/location.jp_city_town",
        "http://rdf.freebase.com/ns/location.jp_designated_city",
        "city, village,...",
        "http://linkedgeodata.org/ontology/Village",
        "http://linkedgeodata.org/ontology/City",
        "http://linkedgeodata.org/ontology/Suburb",
        "http://linkedgeodata.org/ontology/Town",
        "http://umbel.org/umbel/rc/Village",
        "http://umbel.org/umbel/rc/Town",
        "http://umbel.org/umbel/rc/City",
        "http://schema.org/City",
        "http://schema.org/Town",
    ],
    "BodyOfWater": [
        "http://rdf.freebase.com/ns/geography.river",
        "http://rdf.freebase.com/ns/geography.lake",
        "http://rdf.freebase.com/ns/geography.body_of_water",
        "http://dbpedia.org/ontology/BodyOfWater",
        "http://dbpedia.org/ontology/River",
        "http://dbpedia.org/ontology/Lake",
        "http://dbpedia.org/ontology/Ocean",
        "http://dbpedia.org/ontology/Sea",
        "http://dbpedia.org/ontology/Stream",
        "stream",
        "lake",
        "glacier(s)",
        "bay",
        "sea",
        "reservoir(s)",
        "cove(s)",
        "channel",
        "overfalls",
        "canal",
        "fjord",
        "harbor(s)",
        "inlet",
        "spring(s)",
        "waterfall(s)",
    ],
    "Mountain": [
        "http://dbpedia.org/ontology/Mountain",
        "http://dbpedia.org/ontology/MountainPass",
        "http://dbpedia.org/ontology/MountainRange",
        "http://linkedgeodata.org/ontology/Peak",
        "mountain",
        "hill",
        "peak",
        "mountains",
        "ridge(s)",
        "cape",
        "slope(s)",
        "valley",
        "hills",
        "pass",
        "rock",
        "rocks",
        "http://rdf.freebase.com/ns/geography.mountain",
        "http://rdf.freebase.com/ns/geography.mountain_pass",
        "http://rdf.freebase.com/ns/geography.mountain_range",
    ],
    "Island": [
        "http://umbel.org/umbel/rc/Island",
        "http://dbpedia.org/ontology/Island",
        "islands",
        "island",
        "islet",
        "http://linkedgeodata.org/ontology/Island",
        "http://rdf.freebase.com/ns/geography.island",
        "http://rdf.freebase.com/ns/geography.island_group",
    ],
    "School": [
        "http://dbpedia.org/ontology/School",
        "http://dbpedia.org/ontology/University",
        "http://dbpedia.org/ontology/EducationalInstitution",
        "http://linkedgeodata.org/ontology/School",
        "school",
        "http://rdf.freebase.com/ns/education.academic",
        "http://rdf.freebase.com/ns/education.academic_institution",
        "http://rdf.freebase.com/ns/education.department",
        "http://rdf.freebase.com/ns/education.educational_institution",
        "http://rdf.freebase.com/ns/education.educational_institution_campus",
        "http://rdf.freebase.com/ns/education.fraternity_sorority",
        "http://rdf.freebase.com/ns/education.fraternity_sorority_type",
        "http://rdf.freebase.com/ns/education.honorary_degree_recipient",
        "http://rdf.freebase.com/ns/education.school",
        "http://rdf.freebase.com/ns/education.school_category",
        "http://rdf.freebase.com/ns/education.university",
        "http://rdf.freebase.com/ns/education.university_system",
    ],
    "Country": [
        "http://dbpedia.org/ontology/Country",
        "http://rdf.freebase.com/ns/location.country",
        "http://rdf.freebase.com/ns/location.uk_overseas_territory",
        "dependent political entity",
        "http://linkedgeodata.org/ontology/Country",
        "independent political entity",
        "semi-independent political entity",
        "http://umbel.org/umbel/rc/Country",
    ],
    "ArchitecturalStructure": [
        "http://dbpedia.org/ontology/Airport",
        "airport",
        "http://linkedgeodata.org/ontology/AerowayThing",
        "http://linkedgeodata.org/ontology/Airport",
        "http://rdf.freebase.com/ns/aviation.airline",
        "http://rdf.freebase.com/ns/aviation.airport",
        "http://rdf.freebase.com/ns/aviation.airport_operator",
        "http://rdf.freebase.com/ns/aviation.waypoint_type",
        "http://rdf.freebase.com/ns/aviation.aircraft_manufacturer",
        "http://linkedgeodata.org/ontology/Amenity",
        "http://dbpedia.org/ontology/Station",
        "http://dbpedia.org/ontology/LaunchPad",
        "http://dbpedia.org/ontology/Lock",
        "http://dbpedia.org/ontology/Port",
        "http://dbpedia.org/ontology/PowerStation",
        "http://dbpedia.org/ontology/RestArea",
        "http://dbpedia.org/ontology/RouteOfTransportation",
        "http://dbpedia.org/ontology/AmusementParkAttraction",
        "http://dbpedia.org/ontology/Arena",
        "http://dbpedia.org/ontology/Building",
        "http://dbpedia.org/ontology/Gate",
        "http://dbpedia.org/ontology/Infrastructure",
        "http://dbpedia.org/ontology/MilitaryStructure",
        "http://dbpedia.org/ontology/Mill",
        "http://dbpedia.org/ontology/NoteworthyPartOfBuilding",
        "http://dbpedia.org/ontology/Pyramid",
        "http://dbpedia.org/ontology/Shrine",
        "http://dbpedia.org/ontology/Square",
        "http://dbpedia.org/ontology/Tower",
        "http://dbpedia.org/ontology/Tunnel",
        "http://dbpedia.org/ontology/Venue",
        "http://dbpedia.org/ontology/Zoo",
        "http://dbpedia.org/ontology/ShoppingMall",
        "http://dbpedia.org/ontology/Stadium",
        "http://dbpedia.org/ontology/RailwayStation",
        "http://dbpedia.org/ontology/Dam",
        "http://dbpedia.org/ontology/SportFacility",
        "http://rdf.freebase.com/ns/architecture.venue",
        "http://rdf.freebase.com/ns/architecture.building",
        "http://rdf.freebase.com/ns/architecture.building_complex",
        "http://rdf.freebase.com/ns/architecture.landscape_project",
        "http://rdf.freebase.com/ns/architecture.museum",
        "http://rdf.freebase.com/ns/architecture.structure",
        "http://rdf.freebase.com/ns/architecture.building_function",
        "http://rdf.freebase.com/ns/architecture.building_occupant",
        "http://rdf.freebase.com/ns/architecture.skyscraper",
        "http://rdf.freebase.com/ns/architecture.type_of_museum",
        "http://rdf.freebase.com/ns/transportation.road",
        "http://rdf.freebase.com/ns/transportation.bridge",
        "http://rdf.freebase.com/ns/zoos.zoo",
        "http://rdf.freebase.com/ns/zoos.zoo_exhibit",
        "railroad station",
        "tower",
        "building(s)",
        "stadium",
        "church",
        "museum",
        "hostpital",
        "castle",
        "airfield",
        "spot, building, farm, ...",
        "http://linkedgeodata.org/ontology/Leisure",
    ],
}
SECONDARY = {
    "ArchitecturalStructure": [
        "http://dbpedia.org/ontology/ArchitecturalStructure",
        "http://rdf.freebase.com/ns/amusement_parks.park",
    ],
    "AdministrativeRegion": [
        "http://dbpedia.org/ontology/AdministrativeRegion",
        "country, state, region ...",
        "http://rdf.freebase.com/ns/location.administrative_division",
        "http://rdf.freebase.com/ns/location.statistical_region",
        "http://rdf.freebase.com/ns/location.us_state",
        "http://rdf.freebase.com/ns/location.fr_region",
        "http://rdf.freebase.com/ns/location.province",
        "http://rdf.freebase.com/ns/location.in_state",
        "http://rdf.freebase.com/ns/location.mx_state",
        "http://rdf.freebase.com/ns/location.es_autonomous_community",
        "http://rdf.freebase.com/ns/location.fr_department",
        "http://rdf.freebase.com/ns/location.it_comune",
        "http://dbpedia.org/ontology/Region",
    ],
    "Park": [
        "http://linkedgeodata.org/ontology/Park",
        "http://dbpedia.org/ontology/Park",
        "parks,area, ...",
        "http://dbpedia.org/ontology/ProtectedArea",
        "http://rdf.freebase.com/ns/protected_sites.governing_body_of_protected_sites",
        "http://rdf.freebase.com/ns/protected_sites.listed_site",
        "http://rdf.freebase.com/ns/protected_sites.natural_or_cultural_preservation_agency",
        "http://rdf.freebase.com/ns/protected_sites.park_system",
        "http://rdf.freebase.com/ns/protected_sites.protected_site",
        "http://rdf.freebase.com/ns/protected_sites.site_listing_category",
    ],
}

# A type and the broader type that it is compared as.
SHADED = {"School": "ArchitecturalStructure", "Island": "Mountain", "Settlement": "AdministrativeRegion", "Country": "AdministrativeRegion"}
# Pairs of types that count as one.
ALIKE = [("ArchitecturalStructure", "School"), ("Mountain", "Island"), ("Country", "Settlement"), ("Settlement", "AdministrativeRegion"), ("AdministrativeRegion", "Country")]
# Bits of shaded types.
BITS = {"no_type": 0, "Park": 1, "BodyOfWater": 2, "AdministrativeRegion": 4, "Mountain": 8, "ArchitecturalStructure": 16}
NO_TYPE = "no_type"
