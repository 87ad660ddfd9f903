"""Records beside the manuscripts: abstracts as JSON lines, a bibliography, registry records, rewrite pairs and version pairs."""

from __future__ import annotations

#: An abstract bank as JSON lines, two of them unreadable.
ABSTRACTS = (
    '{"source": "arxiv:2101.00001v2", "section": "abstract", "text": "We measure masses of clusters.", "year": 2021, "updated": "2021-05-01", "journal_ref": "ApJ, 927, 101 (2022)", "authors": ["A. Fox", "B. Owl"]}',
    '{"source": "arxiv:2101.00001v3", "section": "abstract", "text": "We measure masses of clusters again.", "year": 2021, "updated": "2023-05-01", "journal_ref": "ApJ, 927, 101 (2022)", "authors": ["A. Fox", "B. Owl"]}',
    '{"source": "arxiv:astro-ph/9901001", "section": "abstract", "text": "An old letter.", "year": 1999, "updated": "1999-01-05", "journal_ref": "Astrophys. J. Lett. 510, L3 (1999)", "authors": ["C. Elk"]}',
    "not json",
    '{"source": "arxiv:2203.5", "text": "cut off',
    '{"source": "arxiv:2203.00005", "section": "abstract", "text": "A survey.", "year": 2022, "updated": null, "journal_ref": "A&A 660, A114 (2022)", "authors": []}',
    '{"source": "arxiv:2204.00009", "section": "abstract", "text": "A review.", "year": 2022, "updated": "2022-04-09", "journal_ref": "Astronomy & Astrophysics Review 3, 1", "authors": ["D. Fox", "E. Elk", "F. Owl"]}',
    '{"source": "arxiv:2205.00001", "section": "abstract", "text": "A supplement.", "year": 2022, "updated": "2022-06-01", "journal_ref": "ApJS 12, 3 (2022)", "authors": ["G. Hen"]}',
)
#: Bibliography of the first manuscript.
BIBLIOGRAPHY = r"""@string{apj = "The Astrophysical Journal"}
@string{apjl = apj # " Letters"}
@comment{left out}
@article{Rich2001, author = {Rich, Ann and Poor, Bob}, title = {The {Mass} of {\"O}sterberg clusters}, journal = apjl, year = 2001, volume = "12", pages = {101--110}, doi = {10.1000/abc.1}}
@article(Fox2010, author = "Carl van Fox AND Dan Owl", title = {Rings of galaxies}, journal = {A\&A}, year = {2010}, url = {https://doi.org/10.1000/def%2F2})
@misc{Unused2000, author = {Elk, Eve}, title = {Nothing}, year = {2000}, eprint = {2101.00001}}
"""
#: Registry records by identifier: family name, year, title, journal, volume, page.
REGISTRY = (
    ("doi:10.1000/abc.1", "Rich", "2001", "The mass of Osterberg clusters", "The Astrophysical Journal Letters", "12", "101"),
    ("doi:10.1000/def/2", "Waerbeke", "2013", "Shapes of stars", "A&A", "", ""),
)
#: Rewrites: reference and candidate.
PAIRS = (
    ("The mass is higher than $M_x$ and not below 43 counts \\cite{A1}, because it is large.", "The mass is higher than $M_x$ and not below 43 counts \\cite{A1}, because it is large."),
    ("We find 1,200 stars, 0.5-1.2 dex and -0.06 mag in 5\\,Mpc.", "We find 1,200 stars, from 0.5 to 1.2 dex and -0.06 mag in 5\\,Mpc."),
    ("It is not lower and it is not red.", "It is not lower and red."),
    ("The HST image shows 43 rings.", "The image shows 44 rings because it is deep."),
    ("It rises by $x^2$ in 1.5 Mpc, the 3rd run in 2020 we made.", "It falls by $x^3$ in 1.5 kpc, the third run in 2020 they made."),
    ("The rate is 1.5e-3 and \\Nconfig runs.", "The rate is 1.5e-3 and runs."),
)
#: What a condensing round must cut, as it may be written.
SHRINKS = ("30%", "0.3", "120", "7%", "0", "100%", "1.0", "-3", "abc", "30%%")
#: Sections whose growth is recorded as justified.
ALLOWANCES = (("methods", "referee asked"), ("results", "new table"))
