"""Fixed values for text scoring: aliases, event patterns and word lists."""

from __future__ import annotations

# Names under which an instrument appears in text.
ALIASES = {
    "OGDC": [
        "Oil & Gas Development Company Limited", "Oil and Gas Development Company Limited",
        "Oil & Gas Development Company", "Oil and Gas Development Company",
        "Oil & Gas Development", "Oil and Gas Development", "OGDCL", "OGDC",
    ],
    "PPL": ["Pakistan Petroleum Limited", "Pakistan Petroleum", "PPL"],
    "ENGRO": ["Engro Corporation Limited", "Engro Corporation", "Engro Corp", "Engro"],
    "FFC": ["Fauji Fertilizer Company Limited", "Fauji Fertilizer Company", "Fauji Fertilizer", "FFC"],
    "LUCK": ["Lucky Cement Limited", "Lucky Cement", "LUCK"],
    "HBL": ["Habib Bank Limited", "Habib Bank", "HBL"],
    "MCB": ["MCB Bank Limited", "MCB Bank", "MCB"],
    "UBL": ["United Bank Limited", "United Bank", "UBL"],
    "HUBC": [
        "The Hub Power Company Limited", "The Hub Power Company", "Hub Power Company",
        "Hub Power", "Hubco", "HUBC",
    ],
    "SYS": ["Systems Limited", "Systems Ltd", "SYS"],
    "GGL": [
        "Ghani Global Glass Ltd.", "Ghani Global Glass Limited", "Ghani Global Glass",
        "Ghani Global", "GGL",
    ],
}

# Tickers that are also words and must match in upper case.
CASE_SENSITIVE = {"LUCK", "SYS", "ENGRO", "AIR", "PACE"}

# Event categories in tie-break order, each with its patterns.
EVENT_PATTERNS = {
    "DISCOVERY": [
        r"\b(?:hydrocarbon|gas|oil)\s+discover(?:y|ies)\b",
        r"\bdiscover(?:y|ed)\s+of\s+(?:oil|gas|hydrocarbons?)\b",
        r"\bwell\s+test\b",
        r"\bexploration\s+well\b",
        r"\bflow\s+rate\b",
        r"\bmmscfd\b",
        r"\bbopd\b",
        r"\breserves?\s+discovered\b",
    ],
    "BONUS_ISSUE": [
        r"\bbonus\s+shares?\b",
        r"\bbonus\s+issue\b",
        r"\bright\s+shares?\b",
        r"\brights?\s+issue\b",
        r"\bright\s+entitlements?\b",
    ],
    "DIVIDEND": [
        r"\bcash\s+dividend\b",
        r"\binterim\s+dividend\b",
        r"\bfinal\s+dividend\b",
        r"\bdividend\s+payout\b",
        r"\bdividend\s+(?:announced|declared|approved|per\s+share)\b",
        r"\bbook\s+closure\b.*dividend",
        r"\bpayout\s+of\s+pkr\b",
    ],
    "EARNINGS": [
        r"\bfinancial\s+results?\b",
        r"\bquarterly\s+results?\b",
        r"\bhalf[- ]yearly\s+results?\b",
        r"\bannual\s+results?\b",
        r"\bprofit\s+after\s+tax\b",
        r"\bnet\s+profit\b",
        r"\bearnings\s+per\s+share\b",
        r"\beps\b",
        r"\bfinancial\s+statements?\b",
        r"\brevenue\s+(?:surge|growth|drop|decline|jumps?)\b",
        r"\bprofit\s+(?:surges?|plunges?|jumps?|falls?|gains?)\b",
        r"\bboard\s+meeting\b.*financial",
    ],
    "PRODUCTION_CHANGE": [
        r"\bplant\s+shutdown\b",
        r"\bmaintenance\s+(?:shutdown|turnaround)\b",
        r"\bproduction\s+(?:halt|suspension|halted|stopped)\b",
        r"\bcapacity\s+expansion\b",
        r"\bcommercial\s+operations?\b",
        r"\bcommercial\s+production\b",
        r"\bsuspension\s+of\s+operations?\b",
        r"\bclosure\s+of\s+plant\b",
    ],
    "REGULATORY": [
        r"\bsecp\s+(?:notice|directive|order|inquiry|approval)\b",
        r"\bpsx\s+circular\b",
        r"\bregulatory\s+approval\b",
        r"\bcourt\s+stay\b",
        r"\bstay\s+order\b",
        r"\bnepra\s+tariff\b",
        r"\bsbp\s+directive\b",
        r"\bcompetition\s+commission\b",
        r"\bshow[- ]cause\s+notice\b",
        r"\bpenalty\s+imposed\b",
        r"\bdelisting\b",
    ],
    "MACRO_INTEREST_RATE": [
        r"\bmonetary\s+policy\b",
        r"\bpolicy\s+rate\b",
        r"\binterest\s+rates?\b",
        r"\bsbp\s+(?:keeps|hikes|cuts|reduces|raises)\s+(?:policy\s+)?rate\b",
        r"\binflation\s+(?:rate|surges|drops|eases)\b",
        r"\bcpi\s+inflation\b",
        r"\bimf\s+(?:tranche|review|mission|program|loan)\b",
        r"\bforeign\s+exchange\s+reserves\b",
        r"\bcurrent\s+account\s+(?:deficit|surplus)\b",
    ],
}

# Words that carry sentiment, negate it or strengthen it.
POSITIVE = """
surge surges surged surging gain gains gained gaining profit profits profitable profitability growth grew grow
jump jumps jumped rally rallied rallies record beat beats beating upgrade upgraded upgrades bullish boom booming
dividend dividends bonus expansion expanded acquisition recovery recovers recovered optimism optimistic highest
soar soared soars uptick outperform outperformed milestone success successful strengthen strengthened inflow
inflows surplus discovery discover discovers discovered discovering
""".split()
NEGATIVE = """
plunge plunges plunged loss losses decline declines declined drop drops dropped fall falls fell slump slumps slumped
deficit deficits default defaulted defaults warning warns warned inflation inflationary shutdown shutdowns downgrade
downgraded downgrades bearish crisis crash crashed penalty penalties fined fine lowest downside underperform
underperformed debt dispute conflict halt halted suspension suspended outflow outflows weakness weakened struggle
struggling
""".split()
NEGATION = "not no never failed fail fails without cannot hardly barely".split()
INTENSIFIER = """
record sharp sharply massive massively substantial substantially historic huge significantly significant steep steeply
""".split()
