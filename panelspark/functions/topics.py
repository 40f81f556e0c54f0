"""What each news topic accepts."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Topic:
    """Desks and sections that pass, tags that need a keyword (broad) or not (tight), keywords,
    and, for topics split in two, the keywords and tags that make an article specific."""

    desks: tuple[str, ...]
    sections: tuple[str, ...]
    broad_tags: tuple[str, ...]
    tight_tags: tuple[str, ...]
    keywords: tuple[str, ...]
    specific_keywords: tuple[str, ...] = ()
    specific_tags: tuple[str, ...] = ()
    specific_name: str = "metal"
    other_name: str = "economy"

    @property
    def split(self) -> bool:
        return bool(self.specific_keywords or self.specific_tags)


# Desks, sections, tags and keywords of the two topics.
STOCKS_TAGS = (
    "Stocks and Bonds", "Standard & Poor's 500-Stock Index", "Nasdaq Composite Index",
    "Dow Jones Stock Index", "Russell 2000 Index", "Initial Public Offerings", "Short Sales",
    "Stock Options and Ownership Plans", "Stock Buybacks", "Insider Trading and Violations",
    "Futures and Options Trading", "Shareholder Rights and Activism", "Dividends",
    "Special Purpose Acquisition Companies (SPAC)", "United States Economy",
    "Inflation (Economics)", "Interest Rates", "Economic Conditions and Trends",
    "Recession and Depression", "Gross Domestic Product", "Consumer Price Index", "Unemployment",
    "Labor and Jobs", "Wages and Salaries", "Layoffs and Job Reductions", "Stimulus (Economic)",
    "Federal Budget (US)", "Prices (Fares, Fees and Rates)", "Customs (Tariff)",
    "Protectionism (Trade)", "Embargoes and Sanctions", "International Trade and World Market",
    "Foreign Investments", "Supply Chain", "Banking and Financial Institutions",
    "Regulation and Deregulation of Industry", "Antitrust Laws and Competition Issues",
    "Securities and Commodities Violations", "Frauds and Swindling", "Boards of Directors",
    "Tax Credits, Deductions and Exemptions", "Income Tax", "Federal Taxes (US)", "Taxation",
    "Mergers, Acquisitions and Divestitures", "Company Reports", "Corporations", "Bankruptcies",
    "Credit and Debt", "Government Bonds", "Currency", "Hedge Funds", "Private Equity",
    "Venture Capital", "Start-ups", "Entrepreneurship", "Small Business", "Income Inequality",
    "Income", "Oil (Petroleum) and Gasoline", "Natural Gas",
    "Alternative and Renewable Energy", "Electric and Hybrid Vehicles", "Computer Chips",
    "Virtual Currency", "E-Commerce", "Advertising and Marketing",
    "Inflation Reduction Act of 2022",
)
STOCKS_KEYWORDS = (
    "nasdaq", "s&p 500", "s&p500", "dow jones", "stock market", "stock exchange", "wall street",
    "ipo", "initial public offering", "earnings", "quarterly results", "stock", "stocks",
    "shares", "equities", "equity", "trading", "market cap", "short selling", "short sell",
    "bull market", "bear market", "rally", "selloff", "sell-off", "federal reserve", "fed rate",
    "interest rate", "interest rates", "inflation", "recession", "gdp", "unemployment",
    "jobs report", "consumer price", "cpi", "tariff", "trade war", "semiconductor", "antitrust",
    "rare earth", "banks", "lenders", "revenue", "profit", "losses", "merger", "acquisition",
    "dividend", "buyback", "debt", "yield", "hedge fund", "private equity", "venture capital",
    "economy", "economic", "financial", "investors", "investment", "growth", "market",
)
METALS_TIGHT_TAGS = (
    "Oil (Petroleum) and Gasoline", "Natural Gas", "Interest Rates", "Gross Domestic Product",
    "Inflation (Economics)", "Recession and Depression", "Customs (Tariff)",
    "Protectionism (Trade)", "Supply Chain", "Coronavirus (2019-nCoV)",
    "Russian Invasion of Ukraine (2022)", "Subprime Mortgage Crisis",
    "European Sovereign Debt Crisis (2010- )", "Japan Earthquake and Tsunami (2011)",
    "Middle East and North Africa Unrest (2010- )", "Electric and Hybrid Vehicles",
    "Computer Chips",
)
METALS_BROAD_TAGS = (
    "United States Economy", "Economic Conditions and Trends",
    "International Trade and World Market", "Customs (Tariff)", "Protectionism (Trade)",
    "Foreign Investments", "Supply Chain", "Prices (Fares, Fees and Rates)",
    "Inflation (Economics)", "Interest Rates", "Recession and Depression",
    "Gross Domestic Product", "Unemployment", "Stimulus (Economic)", "Federal Budget (US)",
    "Banking and Financial Institutions", "Banks and Banking",
    "Mergers, Acquisitions and Divestitures", "Company Reports", "Corporations", "Bankruptcies",
    "Credit and Debt", "Stocks and Bonds", "Hedge Funds", "Private Equity",
    "Regulation and Deregulation of Industry", "Antitrust Laws and Competition Issues",
    "Frauds and Swindling", "Layoffs and Job Reductions", "Organized Labor", "Taxation",
    "Federal Taxes (US)", "Oil (Petroleum) and Gasoline", "Natural Gas",
    "Alternative and Renewable Energy", "Electric and Hybrid Vehicles", "Nuclear Energy",
    "Environment", "Factories and Manufacturing", "Espionage and Intelligence Services",
    "War and Armed Conflicts", "Russian Invasion of Ukraine (2022)", "Subprime Mortgage Crisis",
    "European Sovereign Debt Crisis (2010- )", "Japan Earthquake and Tsunami (2011)",
    "Middle East and North Africa Unrest (2010- )", "Coronavirus (2019-nCoV)", "Automobiles",
    "Science and Technology", "Computer Chips",
)
METALS_SPECIFIC_TAGS = (
    "Supply Chain", "Alternative and Renewable Energy", "Electric and Hybrid Vehicles",
    "Automobiles", "Computer Chips",
)
METALS_SPECIFIC_KEYWORDS = (
    "gold", "silver", "copper", "cobalt", "tungsten", "iron ore", "coking coal",
    "metallurgical coal", "rare earth", "rare earths", "lithium", "nickel", "zinc", "aluminum",
    "aluminium", "platinum", "palladium", "manganese", "chromium", "molybdenum", "vanadium",
    "neodymium", "dysprosium", "praseodymium", "terbium", "indium", "gallium", "germanium",
    "bullion", "commodity", "commodities", "futures", "spot price", "lme",
    "london metal exchange", "comex", "shanghai metals", "metal prices", "base metals",
    "precious metals", "industrial metals", "ore", "smelting", "refining", "alloy", "mining",
    "mine", "miner", "miners", "open pit", "underground mine", "drilling", "extraction",
    "reserves", "ore grade", "rio tinto", "bhp", "glencore", "freeport", "vale",
    "anglo american", "barrick", "newmont", "antofagasta", "china supply", "china dominance",
    "strategic reserve", "stockpile", "export ban", "export restriction", "critical mineral",
    "critical metals", "supply disruption", "mine strike", "production cut", "electric vehicle",
    "ev battery", "battery storage", "energy storage", "solar panel", "wind turbine",
    "green energy", "energy transition", "semiconductor", "chip shortage", "defense spending",
    "arms", "construction", "infrastructure spending", "steel", "stainless steel",
)
ECONOMY_KEYWORDS = (
    "crude oil", "brent", "wti", "opec", "oil price", "oil prices", "natural gas price",
    "energy price", "energy prices", "energy cost", "federal reserve", "interest rate",
    "interest rates", "inflation", "dollar index", "dxy", "commodity prices", "commodity index",
    "recession", "gdp", "trade war", "tariff", "sanctions", "embargo", "china economy",
    "china gdp", "china manufacturing", "china demand", "pmi", "purchasing managers",
    "manufacturing output", "industrial production", "capacity utilization", "global growth",
    "economic slowdown", "economic growth",
)
TOPICS = {
    "stocks": Topic(
        desks=("business", "business day", "entrepreneurs", "financial", "technology", "markets",
               "economy", "dealbook", "u.s.", "energy", "world business", "investing",
               "real estate"),
        sections=("business", "business day", "technology", "u.s.", "world", "your money",
                  "economy", "dealbook", "energy", "real estate"),
        broad_tags=STOCKS_TAGS, tight_tags=STOCKS_TAGS, keywords=STOCKS_KEYWORDS),
    "metals": Topic(
        desks=("business", "business day", "financial", "markets", "economy", "dealbook",
               "technology", "energy", "world business", "investing", "u.s.", "world", "foreign",
               "international", "science", "climate", "national"),
        sections=("business", "business day", "technology", "economy", "dealbook", "energy",
                  "u.s.", "world", "your money", "science", "climate"),
        broad_tags=METALS_BROAD_TAGS, tight_tags=METALS_TIGHT_TAGS,
        keywords=METALS_SPECIFIC_KEYWORDS + ECONOMY_KEYWORDS,
        specific_keywords=METALS_SPECIFIC_KEYWORDS, specific_tags=METALS_SPECIFIC_TAGS),
}
