"""Speaker, domain and event dimensions, and how a slug is looked up in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import title_name
from parlance.operators import relational

# Slug, display name and domain of each speaker.
SPEAKERS = [
    ("ray_dalio", "Ray Dalio", "finance"),
    ("cathie_wood", "Cathie Wood", "finance"),
    ("bill_ackman", "Bill Ackman", "finance"),
    ("bill_gross", "Bill Gross", "finance"),
    ("warren_buffett", "Warren Buffett", "finance"),
    ("jamie_dimon", "Jamie Dimon", "finance"),
    ("stanley_druckenmiller", "Stanley Druckenmiller", "finance"),
    ("howard_marks", "Howard Marks", "finance"),
    ("larry_fink", "Larry Fink", "finance"),
    ("david_tepper", "David Tepper", "finance"),
    ("paul_tudor_jones", "Paul Tudor Jones", "finance"),
    ("mohamed_el_erian", "Mohamed El-Erian", "finance"),
    ("nouriel_roubini", "Nouriel Roubini", "finance"),
    ("david_einhorn", "David Einhorn", "finance"),
    ("jeremy_grantham", "Jeremy Grantham", "finance"),
    ("jeff_gundlach", "Jeff Gundlach", "finance"),
    ("david_rosenberg", "David Rosenberg", "finance"),
    ("michael_burry", "Michael Burry", "finance"),
    ("george_soros", "George Soros", "finance"),
    ("charlie_munger", "Charlie Munger", "finance"),
    ("mohamed_el-erian", "Mohamed El-Erian", "finance"),
    ("donald_trump", "Donald Trump", "politics"),
    ("joe_biden", "Joe Biden", "politics"),
    ("hillary_clinton", "Hillary Clinton", "politics"),
    ("bernie_sanders", "Bernie Sanders", "politics"),
    ("nancy_pelosi", "Nancy Pelosi", "politics"),
    ("boris_johnson", "Boris Johnson", "politics"),
    ("emmanuel_macron", "Emmanuel Macron", "politics"),
    ("narendra_modi", "Narendra Modi", "politics"),
    ("recep_erdogan", "Recep Erdogan", "politics"),
    ("viktor_orban", "Viktor Orban", "politics"),
    ("volodymyr_zelenskyy", "Volodymyr Zelenskyy", "politics"),
    ("jd_vance", "JD Vance", "politics"),
    ("nikki_haley", "Nikki Haley", "politics"),
    ("ron_desantis", "Ron DeSantis", "politics"),
    ("gavin_newsom", "Gavin Newsom", "politics"),
    ("pete_buttigieg", "Pete Buttigieg", "politics"),
    ("ted_cruz", "Ted Cruz", "politics"),
    ("josh_hawley", "Josh Hawley", "politics"),
    ("marco_rubio", "Marco Rubio", "politics"),
    ("mitt_romney", "Mitt Romney", "politics"),
    ("elizabeth_warren", "Elizabeth Warren", "politics"),
    ("tulsi_gabbard", "Tulsi Gabbard", "politics"),
    ("rand_paul", "Rand Paul", "politics"),
    ("newt_gingrich", "Newt Gingrich", "politics"),
    ("dan_crenshaw", "Dan Crenshaw", "politics"),
    ("tom_cotton", "Tom Cotton", "politics"),
    ("david_cameron", "David Cameron", "politics"),
    ("antony_blinken", "Antony Blinken", "politics"),
    ("ursula_von_der_leyen", "Ursula von der Leyen", "politics"),
    ("mark_esper", "Mark Esper", "politics"),
    ("james_mattis", "James Mattis", "politics"),
    ("mike_pompeo", "Mike Pompeo", "politics"),
    ("kenneth_rogoff", "Kenneth Rogoff", "academia"),
    ("daron_acemoglu", "Daron Acemoglu", "academia"),
    ("paul_krugman", "Paul Krugman", "academia"),
    ("joseph_stiglitz", "Joseph Stiglitz", "academia"),
    ("carmen_reinhart", "Carmen Reinhart", "academia"),
    ("barry_eichengreen", "Barry Eichengreen", "academia"),
    ("robert_shiller", "Robert Shiller", "academia"),
    ("niall_ferguson", "Niall Ferguson", "academia"),
    ("jeffrey_sachs", "Jeffrey Sachs", "academia"),
    ("branko_milanovic", "Branko Milanovic", "academia"),
    ("raghuram_rajan", "Raghuram Rajan", "academia"),
    ("paul_romer", "Paul Romer", "academia"),
    ("tyler_cowen", "Tyler Cowen", "academia"),
    ("noam_chomsky", "Noam Chomsky", "academia"),
    ("richard_wolff", "Richard Wolff", "academia"),
    ("yanis_varoufakis", "Yanis Varoufakis", "academia"),
    ("lawrence_summers", "Lawrence Summers", "academia"),
    ("mariana_mazzucato", "Mariana Mazzucato", "academia"),
    ("michael_pettis", "Michael Pettis", "academia"),
    ("stephanie_kelton", "Stephanie Kelton", "academia"),
    ("stephen_roach", "Stephen Roach", "academia"),
    ("jerome_powell", "Jerome Powell", "central_banking"),
    ("janet_yellen", "Janet Yellen", "central_banking"),
    ("ben_bernanke", "Ben Bernanke", "central_banking"),
    ("alan_greenspan", "Alan Greenspan", "central_banking"),
    ("christine_lagarde", "Christine Lagarde", "central_banking"),
    ("mario_draghi", "Mario Draghi", "central_banking"),
    ("neel_kashkari", "Neel Kashkari", "central_banking"),
    ("jim_bullard", "Jim Bullard", "central_banking"),
    ("john_williams", "John Williams", "central_banking"),
    ("peter_zeihan", "Peter Zeihan", "geopolitics"),
    ("henry_kissinger", "Henry Kissinger", "geopolitics"),
    ("john_mearsheimer", "John Mearsheimer", "geopolitics"),
    ("ian_bremmer", "Ian Bremmer", "geopolitics"),
    ("fiona_hill", "Fiona Hill", "geopolitics"),
    ("condoleezza_rice", "Condoleezza Rice", "geopolitics"),
    ("robert_gates", "Robert Gates", "geopolitics"),
    ("richard_haass", "Richard Haass", "geopolitics"),
    ("stephen_walt", "Stephen Walt", "geopolitics"),
    ("john_bolton", "John Bolton", "geopolitics"),
    ("graham_allison", "Graham Allison", "geopolitics"),
    ("eliot_cohen", "Eliot Cohen", "geopolitics"),
    ("emma_ashford", "Emma Ashford", "geopolitics"),
    ("michael_mcfaul", "Michael McFaul", "geopolitics"),
    ("robert_kagan", "Robert Kagan", "geopolitics"),
    ("samantha_power", "Samantha Power", "geopolitics"),
    ("elon_musk", "Elon Musk", "technology"),
    ("sam_altman", "Sam Altman", "technology"),
    ("peter_thiel", "Peter Thiel", "technology"),
    ("marc_andreessen", "Marc Andreessen", "technology"),
    ("eric_weinstein", "Eric Weinstein", "technology"),
    ("scott_bessent", "Scott Bessent", "technology"),
    ("david_solomon", "David Solomon", "finance"),
    ("lloyd_blankfein", "Lloyd Blankfein", "finance"),
    ("vivek_ramaswamy", "Vivek Ramaswamy", "technology"),
    ("ben_shapiro", "Ben Shapiro", "media"),
    ("tucker_carlson", "Tucker Carlson", "media"),
    ("jordan_peterson", "Jordan Peterson", "media"),
    ("ezra_klein", "Ezra Klein", "media"),
    ("sam_harris", "Sam Harris", "media"),
    ("bari_weiss", "Bari Weiss", "media"),
    ("fareed_zakaria", "Fareed Zakaria", "media"),
    ("david_brooks", "David Brooks", "media"),
    ("thomas_friedman", "Thomas Friedman", "media"),
    ("bret_stephens", "Bret Stephens", "media"),
    ("douglas_murray", "Douglas Murray", "media"),
    ("charles_murray", "Charles Murray", "media"),
    ("andrew_sullivan", "Andrew Sullivan", "media"),
    ("matt_taibbi", "Matt Taibbi", "media"),
    ("glenn_greenwald", "Glenn Greenwald", "media"),
    ("anne_applebaum", "Anne Applebaum", "media"),
    ("adam_tooze", "Adam Tooze", "media"),
]

# Domains in their order, with labels.
DOMAINS = [
    ("finance", "Finance/Investing"),
    ("politics", "Politics/Government"),
    ("academia", "Academia/Economics"),
    ("central_banking", "Central Banking/Policy"),
    ("geopolitics", "Geopolitics/Strategy"),
    ("technology", "Technology/Business"),
    ("media", "Media/Commentary"),
]

# Months of events.
EVENTS = [
    ("covid_start", "2020-03"),
    ("covid_vaccine", "2020-12"),
    ("ukraine_invasion", "2022-02"),
    ("fed_hikes_start", "2022-03"),
    ("svb_collapse", "2023-03"),
    ("us_election_2024", "2024-11"),
]


def speakers(spark: SparkSession) -> DataFrame:
    """speaker (slug), display and domain."""
    return spark.createDataFrame(SPEAKERS, "speaker string, display string, domain string")


def domains(spark: SparkSession) -> DataFrame:
    """domain, label and domain_ord."""
    return spark.createDataFrame([(d, label, i) for i, (d, label) in enumerate(DOMAINS)], "domain string, label string, domain_ord int")


def events(spark: SparkSession) -> DataFrame:
    """event and month."""
    return spark.createDataFrame(EVENTS, "event string, month string")


def with_domain(rows: DataFrame, dimension: DataFrame | None = None, speaker: str = "speaker") -> DataFrame:
    """rows with display and domain; a speaker that the dimension lacks is shown by the slug's words, domain `unknown`."""
    dim = (speakers(rows.sparkSession) if dimension is None else dimension).select(F.col("speaker").alias(speaker), "display", "domain")
    out = relational.lookup(rows, dim, [speaker], {"domain": "unknown"})
    return out.withColumn("display", F.coalesce("display", title_name(F.col(speaker))))
