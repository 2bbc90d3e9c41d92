"""The rules that the query applies and a small labelled table of URLs."""

#: Fixed values: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

BLOCKED = [
    "http://casino-bonus.example.com/play/now",
    "http://www.casino-royal.example.net/en/slots",
    "https://online-casino.example.org/win/big",
    "https://casino-win.example.net/jackpot",
    "http://win-money.example.com/casino/en/7",
    "http://free-bets.example.com/en/odds",
    "https://m.bets-today.example.net/free/9",
    "https://sports-bets.example.org/en/421",
    "http://poker-bets.example.com/de/33",
    "http://cheap-pills.example.com/buy/5",
    "https://pills-online.example.net/cheap/en/12",
    "https://blog.cheap-meds.example.org/pills.html",
    "http://diet-pills.example.net/fr/87",
    "http://adult-video.example.com/en/71",
    "https://www.adult-chat.example.net/x/18",
    "https://adult-cams.example.org/xxx/4",
    "http://xxx-adult.example.com/es/90",
    "http://ads-server.example.com/track/1",
    "https://ads-track.example.net/pixel/220",
    "https://m.ads-click.example.org/track/en/8",
    "http://track-ads.example.com/de/531",
    "http://spam-links.example.com/en/15",
    "https://spam-farm.example.net/link/64",
    "https://link-farm.example.org/spam/fr/2",
    "http://www.spam-seo.example.net/farm.html",
    "https://payday-loans.example.com/en/fast",
    "http://loans-fast.example.net/payday/3",
    "http://replica-watch.example.org/cheap/6",
]

ALLOWED = [
    "http://library.example.com/en/1024",
    "https://www.library.example.org/fr/88.html",
    "https://news.example.com/en/2021",
    "http://m.news.example.net/de/345/",
    "https://blog.garden.example.com/en/77",
    "http://blog.cooking.example.net/es/902.html",
    "https://school.example.org/en/5",
    "http://www.school.example.com/fr/43/",
    "https://history.example.net/de/6120",
    "https://science.example.org/en/733#top",
    "http://m.science.example.com/es/28",
    "https://weather.example.net/en/400/",
    "http://maps.example.com/de/9910",
    "https://museum.example.org/fr/12",
    "http://www.music.example.net/en/318.html",
    "https://health.example.com/es/640",
    "http://m.health.example.org/en/71/",
    "https://travel.example.net/fr/2048",
    "http://blog.travel.example.com/de/17",
    "https://theatre.example.org/en/56",
    "http://www.thinking.example.net/en/804",
    "https://another.example.com/es/1500.html",
    "http://station.example.org/de/62",
    "https://nation.example.net/fr/305/",
    "http://m.then.example.com/en/48",
    "https://other.example.org/es/7",
    "http://blog.weather.example.net/en/9023",
    "https://university.example.com/fr/110",
    "http://kitchen.example.net/de/29",
    "https://reading.example.org/en/17001",
    "http://www.handle.example.com/en/36",
    "https://m.thread.example.net/es/455",
    "",
]
