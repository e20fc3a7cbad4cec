"""Yearly price inflation, the year's over the year before (wholesale prices)."""

INFLATION: dict[int, float] = {
    2006: 0.0470, 2007: 0.0440, 2008: 0.0810, 2009: 0.0380, 2010: 0.0960, 2011: 0.0890, 2012: 0.0740, 2013: 0.0600, 2014: 0.0200, 2015: -0.0370,
    2016: 0.0170, 2017: 0.0300, 2018: 0.0430, 2019: 0.0170, 2020: 0.0130, 2021: 0.1300, 2022: 0.0940, 2023: -0.0070, 2024: 0.0200, 2025: 0.0250,
}

#: District names of yearly statistics -> names on the map.
APY_NAMES: dict[str, str] = {
    "Ayodhya": "Faizabad",
    "Bara Banki": "Barabanki",
    "Bhadohi": "Sant Ravi Das Nagar",
    "Kheri": "Lakhimpur Kheri",
    "Mahrajganj": "Maharajganj",
    "Prayagraj": "Allahabad",
    "Shrawasti": "Shravasti",
    "Siddharthnagar": "Siddharth Nagar",
}
