"""Word lists of the news engine."""

from __future__ import annotations

#: Words that the clustering vocabulary leaves out.
STOPWORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by
    can could did do does doing down during each few for from further had has have having he her here hers him his how i if
    in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own per said
    same says she should so some such than that the their theirs them then there these they this those through to too under
    until up very was we were what when where which while who whom why will with would you your yours""".split()
)

#: Sentiment weights of words, from the most positive to the most negative.
SENTIMENT = {
    3: "approval approve approved approves bullish rallied rallies rally soar soared soaring soars surge surged surges surging",
    2: """beat beats boom booming breakout breakthrough buyback buybacks climb climbed climbs exceed exceeded exceeds gain gained
    gains inflow inflows jump jumped jumps optimism optimistic outperform outperformed outperforms rebound rebounded rebounds
    recover recovered recovers recovery surpass surpassed surpasses upbeat upgrade upgraded upgrades""",
    1: """accelerate accelerates accelerating adoption advance advanced advances dividend expands expansion grew growth milestone
    partnership profit profitable profits record settle settled strong stronger strongest win wins won""",
    -1: "delay delayed delays strike strikes volatile volatility weak weaker weakest",
    -2: """decline declined declines drop dropped drops fall falling falls fear fears fell fined fines halt halted halts
    investigates investigating investigation jitters loss losses miss missed misses outage outflow outflows penalties penalty
    probe probes sanction sanctioned sanctions sank shutdown sink sinks slashed slashing slid slide slides slump slumps suspend
    suspended suspends warn warned warning warns""",
    -3: """attack attacked attacks ban banned bans bearish breach breached crisis default defaulted defaults downgrade downgraded
    downgrades downturn exploit exploited hacker hackers lawsuit lawsuits layoff layoffs liquidated liquidation liquidations
    panic plummet plummeted plummets plunge plunged plunges reject rejected rejection rejects rout selloff sue sued sues tumble
    tumbled tumbles tumbling turmoil war""",
    -4: "bankrupt bankruptcy collapse collapsed collapses crash crashed crashes fraud fraudulent hack hacked insolvent scam",
}
#: Words that flip, and words that stretch, the weight of the next ones.
NEGATORS = ("not", "no", "never", "without", "denies", "denied", "deny", "isn't", "aren't", "wasn't", "doesn't", "don't", "didn't", "won't", "can't")
INTENSIFIERS = {
    "sharply": 1.5, "dramatically": 1.5, "massively": 1.5, "hugely": 1.5, "significantly": 1.3, "deeply": 1.3,
    "slightly": 0.5, "modestly": 0.5, "marginally": 0.5, "barely": 0.5, "somewhat": 0.7,
}

#: Entities by type, and their names in text; a name that begins with = is matched in its own letter case.
ENTITIES = {
    "asset": {
        "btc": "bitcoin,=BTC", "eth": "ethereum,=ETH,=Ether", "sol": "solana,=SOL", "xrp": "=XRP,ripple", "doge": "dogecoin,=DOGE", "bnb": "=BNB",
        "ada": "cardano,=ADA", "usdt": "tether,=USDT", "usdc": "=USDC",
    },
    "topic": {
        "stablecoins": "stablecoin,stablecoins", "defi": "=DeFi,decentralized finance", "nft": "=NFT,=NFTs", "crypto-etf": "spot etf,bitcoin etf,ether etf,crypto etf",
        "mining": "bitcoin miner,bitcoin miners,bitcoin mining,crypto mining", "halving": "halving", "oil": "crude oil,brent crude,=WTI,oil prices",
        "gold": "gold price,gold prices,bullion", "dollar": "us dollar,=USD,greenback", "ai": "artificial intelligence,=AI",
        "semiconductors": "semiconductor,semiconductors,chipmaker,chipmakers",
    },
    "org": {"coinbase": "coinbase", "binance": "binance", "kraken": "kraken", "okx": "=OKX", "bybit": "bybit", "grayscale": "grayscale"},
    "macro": {
        "fed": "federal reserve,=Fed,=FOMC,jerome powell", "ecb": "european central bank,=ECB,lagarde", "boe": "bank of england,=BoE", "boj": "bank of japan,=BOJ",
        "sec": "=SEC,securities and exchange commission", "cftc": "=CFTC", "cpi": "=CPI,consumer price index", "inflation": "inflation,disinflation",
        "interest-rates": "interest rate,interest rates,rate hike,rate cut,rate hikes,rate cuts", "treasury": "=Treasury,treasury yields,treasury bonds",
        "gdp": "=GDP,gross domestic product", "jobs": "nonfarm payrolls,jobs report,unemployment rate,jobless claims", "tariffs": "tariff,tariffs,trade war",
        "recession": "recession", "imf": "=IMF,international monetary fund", "opec": "=OPEC", "trump": "=Trump,donald trump", "white-house": "white house", "congress": "=Congress,=Senate",
    },
    "company": {
        "microstrategy": "microstrategy,=MSTR", "apple": "=Apple,=AAPL,=iPhone", "tesla": "tesla,=TSLA,elon musk", "nvidia": "nvidia,=NVDA", "microsoft": "microsoft,=MSFT",
        "google": "google,alphabet,=GOOGL", "amazon": "=Amazon,=AMZN,=AWS", "meta": "=Meta,facebook,instagram,=META", "openai": "openai,chatgpt", "intel": "=Intel,=INTC",
        "amd": "=AMD", "netflix": "netflix,=NFLX", "jpmorgan": "jpmorgan,jp morgan", "goldman": "goldman sachs,=Goldman", "boeing": "boeing", "disney": "=Disney,=DIS",
        "tsmc": "=TSMC,taiwan semiconductor", "samsung": "samsung",
    },
    "league": {
        "premier-league": "premier league,=EPL", "la-liga": "la liga,=LaLiga", "bundesliga": "bundesliga", "serie-a": "serie a", "ligue-1": "ligue 1",
        "mls": "=MLS,major league soccer", "champions-league": "champions league,=UCL",
    },
    "team": {
        "man-city": "manchester city,man city", "man-united": "manchester united,man united,man utd", "liverpool": "liverpool", "arsenal": "=Arsenal",
        "real-madrid": "real madrid", "barcelona": "barcelona,barça", "bayern": "bayern munich,=Bayern",
    },
    "country": {
        "usa": "united states,=U.S.,=US,=USA", "china": "=China,beijing", "russia": "russia,kremlin", "ukraine": "ukraine,kyiv", "israel": "israel", "iran": "iran,tehran",
        "japan": "japan,tokyo", "germany": "germany,berlin", "uk": "united kingdom,=UK,britain", "india": "india,new delhi", "taiwan": "taiwan",
        "eu": "european union,=EU,brussels", "france": "france,paris",
    },
}


def sentiment_words() -> list[tuple[str, float]]:
    return [(word, float(weight)) for weight, words in SENTIMENT.items() for word in words.split()]


def aliases() -> list[tuple[str, str, str, bool]]:
    """(entity, type, alias, whether its letter case counts)."""
    return [
        (entity, kind, name.removeprefix("="), name.startswith("="))
        for kind, entities in ENTITIES.items() for entity, names in entities.items() for name in names.split(",")
    ]


def alias_pattern(alias: str) -> str:
    """A regular expression for an alias as whole words: no ASCII letter, digit or underscore around it, after a full stop no letter or digit.

    Look-arounds say so, as the word boundary of Java's expressions also counts letters beyond ASCII.
    """
    end = "(?![A-Za-z0-9_])" if alias[-1].isascii() and alias[-1].isalnum() else "(?![A-Za-z0-9])"
    return f"(?<![A-Za-z0-9_]){alias.replace('.', '[.]')}{end}"
