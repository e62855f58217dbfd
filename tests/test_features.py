from decimal import Decimal

from hexgiving.operators import features


def test_venue_cards_all_fields(spark):
    v = spark.createDataFrame(
        [("V1", "Hall", "Hotel", 250, Decimal("4.20"), "$$$", "Town", "SC", "29601", "www.x.org"),
         ("V2", "Barn", "Event Venue", None, None, "$$", "Town", "SC", "29650", ""),
         ("V3", "Club", "Golf Club", 80, Decimal("4.70"), "$$$$", "Town", "SC", "29607", None)],
        "venue_id string, venue_name string, venue_type string, capacity int, rating decimal(3,2), "
        "price_range string, city string, state string, zip_code string, website string")
    cards = {r.venue_id: r for r in features.venue_cards(v).collect()}
    assert cards["V1"].title == "Hall - Hotel" and cards["V1"].rating_text == "4.20/5.0"
    assert cards["V1"].address_line == "Town, SC 29601" and cards["V1"].website_text == "Website: www.x.org"
    assert cards["V2"].website_text is None and cards["V3"].website_text is None
    assert cards["V2"].capacity_text == "None" and cards["V2"].rating_text == "None/5.0"


def test_donor_table_headers_page_and_currency(edge_donors):
    t = features.donor_table(edge_donors, 5)
    assert t.columns == ["Name", "Zip", "Grad Year", "Annual Donation", "Total Lifetime", "Segment", "Age"]
    rows = t.collect()
    assert len(rows) == 5 and rows[0]["Annual Donation"] == "$1,000"      # D001: 999.99 rounds to $1,000
    assert features.donor_table(edge_donors, None).count() == edge_donors.count()


def test_venue_features_defaults(spark):
    v = spark.createDataFrame([("V1", "Hall", "Hotel", None, None, "$$", 34.8, -82.4)],
                              "venue_id string, venue_name string, venue_type string, capacity int, "
                              "rating decimal(3,2), price_range string, latitude double, longitude double")
    r = features.venue_features(v).collect()[0]
    assert (r.capacity, r.rating) == (0, 0.0)
    assert r.annual_formatted == "Capacity: N/A" and r.cumulative_formatted == "Rating: N/A/5"
    assert r.donor_segment == "Event Venue - Hotel" and r.graduation_year == "Venue"
