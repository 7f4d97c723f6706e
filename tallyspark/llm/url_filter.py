"""URL filter: rules on host and path first, then logistic regression on hashed character n-grams.

The regression learns from a small labelled table of URLs (block or allow), given below or passed in. Its
features are the counts, as logarithms, of character n-grams of host and of path, hashed to a fixed number of weights,
host and path with seeds of their own, each part scaled to length one. Dots, hyphens and digits bound the words of a host, so that short words are n-grams of their own. Its offset isn't learned: it says that one address of `PRIOR`
is unwanted, so an address whose n-grams are all unknown is allowed.

Cases. A null URL, or one without ://, has empty host and path; the method judges these as it does others. Equal URLs
get equal verdicts, whether identifiers are null or repeated. Whole URLs are read, however long. Columns named host, path, rule, block_score or verdict
pass by with `_in` after their names, other columns as they are; an empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import aside, short_batches

#: Host and path prefix, and the verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
WIDTH, SIZES, PENALTY, CUT, PRIOR = 1 << 17, (3, 4, 5, 6), 0.0002, 0.5, 5
BOUNDS = re.compile(r"[.\-_0-9]+")
#: Bytes whose n-grams are looked at together.
BLOCK = 1 << 20
#: Features whose products are added together in the fit.
FEATURES = 2048

#: The labelled table: hosts and paths of unwanted and of wanted pages.
BLOCK_HOSTS = """casinoroyale777.com bestonlinecasino.bet luckyslots.win pokerstars-bonus.biz megajackpot.xyz free-spins-casino.top roulette-vip.club
sportsbet365.info bet-on-football.xyz bookmaker-odds.biz winbigbets.com bingo-bonus.online lottery-winner.click scratchcards4u.info
viagra-online.biz cheap-cialis.info pharmacy-no-prescription.top discount-meds.xyz buy-pills-online.com weightloss-miracle.biz dietpills24.shop
payday-loans-fast.com quick-cash-loan.biz bad-credit-loans.info debt-relief-now.click forex-robot-profit.com crypto-doubler.xyz earn-bitcoin-fast.top
make-money-online4u.biz get-rich-quick.info work-from-home-cash.click binary-options-profit.xyz free-iphone-giveaway.win claim-your-prize.top surveys-4-cash.biz
xxx-tube.com freeporn-videos.xxx hotgirls-webcam.live adult-dating-now.com sexchat-live.cam nude-celebs.xyz milf-hookup.click escort-girls.info
replica-watches-shop.biz fake-rolex.top cheap-handbags-outlet.shop designer-replica.xyz cheapjerseys-wholesale.biz
torrent-freedownload.xyz crack-serial-keygen.com warez-full.biz nulled-scripts.top free-movies-download.click watch-series-free.xyz moviez-stream.top
adserver-track.com banner-exchange.biz doubleclick-ads.info popunder-ads.xyz click-tracker.top pixel-tracking.biz adnetwork-cpa.click affiliate-offers.biz
seo-backlinks-cheap.com buy-followers.biz link-farm-directory.info spam-mailer.top bulk-email-blast.biz article-spinner.xyz autoblog-spam.com
verify-account-login.top secure-paypal-update.xyz bank-login-confirm.click apple-id-suspended.info""".split()
ALLOW_HOSTS = """wikipedia.org github.com python.org bbc.co.uk nytimes.com lemonde.fr spiegel.de elpais.com theguardian.com reuters.com
mit.edu stanford.edu ox.ac.uk ethz.ch uni-heidelberg.de sorbonne-universite.fr nasa.gov noaa.gov europa.eu gov.uk who.int un.org
archive.org gutenberg.org arxiv.org nature.com plos.org jstor.org springer.com acm.org ieee.org britannica.com merriam-webster.com
stackoverflow.com mozilla.org kernel.org debian.org apache.org postgresql.org rust-lang.org golang.org readthedocs.io
weather.com nationalgeographic.com smithsonianmag.com metmuseum.org louvre.fr tate.org.uk rijksmuseum.nl
allrecipes.com seriouseats.com gardenersworld.com birdwatching.org hikingtrails.net cyclinguk.org trainspotting.co chess.com
citylibrary.org townhall.gov schooldistrict.us childrenshospital.org redcross.org amnesty.org unicef.org greenpeace.org
bloglines.com wordsmith.org poetryfoundation.org classicalmusic.fm jazzhistory.org filmreview.net bookclub.com
farmersmarket.com bakery-berlin.de boulangerie.fr hotel-alpenblick.at bikeshop.nl carpentry.info localnews.com harbourtown.co.nz
mathforum.org physicsworld.com chemistryviews.org history.com archaeology.org genealogy.net maps.org travelguide.com museum-of-science.org
localhost intranet.company mail.server.lan docs.project.dev wiki.team.io""".split()
BLOCK_PATHS = """/casino/free-spins /slots/bonus-code /poker/play-now /bets/live-odds /win/jackpot /claim-prize.php?id=9 /free-bonus /buy-viagra.html
/cheap-pills/order-now /pharmacy/no-prescription /loans/apply-now-fast /make-money-fast /crypto/double-your-money /xxx/video-123 /porn/hd /adult/cams/live /sex-chat
/hot-singles-near-you /dating/hookup /torrent/full-crack /download/keygen.exe /warez/serial /ads/banner.gif /adclick?campaign=77 /track/pixel.gif /popunder.js
/affiliate/redirect?offer=5 /seo/cheap-backlinks /replica-watches /login/verify-account /spam/unsubscribe /free-movies/watch-online""".split()
ALLOW_PATHS = """/ /index.html /about /contact /news/2021/03/14/city-council-meets /articles/introduction-to-botany /en/home /de/impressum.html /fr/accueil /es/noticias /chapter-3.html /page/9/
/blog/2019/how-we-built-our-garden /docs/tutorial/getting-started.html /research/publications /science/astronomy/planets /history/middle-ages /sports/football/results /health/nutrition-guide
/books/chapter-7 /recipes/lentil-soup /library/catalogue /events/calendar /courses/linear-algebra /archive/1998 /questions/4821/reading-a-file /weather/forecast /travel/norway /music/reviews
/wiki/Main_Page /2020/05/17/a-walk-in-the-hills /products/bicycle-lamps /legal/privacy /faq /people/staff /posts/1234 /item/5120""".split()


#: Words of unwanted and of wanted hosts, and what either kind is combined with. Among the wanted ones are words that begin or end as unwanted ones do.
BLOCK_WORDS = """casino casinos poker holdem slots slot roulette blackjack baccarat craps keno jackpot betting bets bet wager sportsbook bookie bookmaker lottery lotto raffle bingo vegas spin spins freespins
gamble gambling stake odds tipster punt viagra cialis levitra pills pill pharmacy meds rx steroids hgh opioids xanax tramadol payday loans loan creditfix cashadvance forex fx-signals cryptoprofit bitcoin-doubler
doubler airdrop getrich richquick giveaway freegift prizes prize winner freebies porn porno xxx sex sexy adult nsfw cam cams camgirls webcams escort escorts hookup hookups dating milf nude nudes naked erotic erotica hentai
fetish strip stripper swingers teens onlygirls hotgirls babes horny playmates torrent torrents torrentz warez crack cracked cracks keygen serialz nulled pirated pirate rip free-movies streamz adserver adtrack adclick ads popads popups
clickbait banners banner tracker tracking spam spammer bulkmail massmail seo-links backlinks linkfarm linkfarms followers likes replica replicas fake-watches fakes knockoff counterfeit phishing phish malware trojan
hack hacks cheats scam botnet login-verify account-verify secure-login wallet-verify miracle-diet dietpills fatburner slimfast""".split()
ALLOW_WORDS = """news daily times journal library museum science history garden recipes cooking baking weather station travel hiking sailing cycling football
chess music jazz opera theatre film photo art poetry books school college university academy teaching research physics chemistry biology maths astronomy health hospital
clinic city council parliament embassy church charity nature birds forest river harbour mountain farm market bakery hotel bank insurance software
linux coding data maps trains railway airport energy engineering architecture law economics sports video stories forum blog shop
camera campus camping cambridge essex sussex spinach spine alphabet better betty bethlehem adventure address admin advice loaned exercise express pillow spine-clinic lotus slotted
craftsman trackfield bannerman winter window winery datacenter datatype updates candle seoul steward winners-school stakeholder oddfellows pilgrim pirouette crackers cracow hackney chart cheese
escarpment adulthood-studies sexton middlesex porridge portal portrait nutrition studio stripes teacher tennis likelihood follow linkedlists linguistics cashmere cashew credit-union bonus-track rental lending-library
wiki docs project people company team group center house home world online store media design labs tools cloud network service society institute foundation club guide review house-of-wool works press""".split()
AROUND = ("{}.com", "www.{}.org", "{}-online.net", "best{}.com", "my{}24.info", "the-{}.co", "{}world.io", "{}.xyz", "m.{}.net", "{}hub.com", "{}-games.com", "get-{}.biz", "{}palace.net", "blue{}.org", "{}.co.uk", "{}s4u.top", "city{}.de", "{}live.tv", "{}.info", "old-{}.fr")
#: Words that no kind has of its own, so that neighbours of a word say little.
PLAIN = """therno ande whoth lerest inger thenal reath ounder ithan oresti eaux quelle ieron lachen undor gelich nichver schalt menten aromi delos quera pador sanen rillo tavone mersil ostave brelin""".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 for block). An unwanted host is so with any path, an unwanted path on any host."""
    rows = [("", "", 0)]
    for y, hosts, words, each in ((1, BLOCK_HOSTS, BLOCK_WORDS, 4), (0, ALLOW_HOSTS, [*ALLOW_WORDS, *PLAIN], 4)):
        made = [AROUND[(i + 5 * k) % len(AROUND)].format(w) for i, w in enumerate(words) for k in range(each)]
        # a word side by side with a plain one, before it or behind
        made += [f"{w}{PLAIN[i % len(PLAIN)]}.com" if i % 2 else f"{PLAIN[i % len(PLAIN)]}{w}.net" for i, w in enumerate(words)]
        for i, h in enumerate([*hosts, *made]):
            rows.append((h, ALLOW_PATHS[(7 * i) % len(ALLOW_PATHS)], y))
    rows += [(h, p, 1) for i, p in enumerate(BLOCK_PATHS) for h in ("", ALLOW_HOSTS[i], ALLOW_HOSTS[-i])]
    return rows + [("", p, 0) for p in ALLOW_PATHS]


def grams(hosts: Sequence[str], paths: Sequence[str], sizes: Sequence[int] = SIZES, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and values of many addresses. The words of a host are bounded by dots, so their starts and ends are seen.

    An n-gram's hash is a polynomial in its bytes; the features of hosts are even, those of paths odd.
    """
    out = []
    for side, texts in ((0, [f".{BOUNDS.sub('.', h)}." for h in hosts]), (1, list(paths))):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        of = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        feature, row = [], []
        for n in sizes:
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, n, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0x9E3779B97F4A7C15)
            whole = of[: len(h)] == of[n - 1 :]
            feature.append(((h >> np.uint64(40)) % np.uint64(width // 2)).astype(np.int64)[whole] * 2 + side)
            row.append(of[: len(h)][whole])
        if not feature:
            continue
        at, count = np.unique(np.concatenate(row) * width + np.concatenate(feature), return_counts=True)
        row, value = at // width, np.log1p(count)
        norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(raw)))
        out.append((row, at % width, value / norm[row]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class UrlModel:
    """Penalised logistic regression, both labels weighing the same; Newton's steps on the rows' products, as rows are fewer than weights."""

    def __init__(self, rows: Iterable[tuple[str, str, int]] | None = None, width: int = WIDTH, penalty: float = PENALTY, steps: int = 12):
        rows = list(labelled_urls() if rows is None else rows)
        row, feature, value = grams([r[0] for r in rows], [r[1] for r in rows], width=width)
        used, feature = np.unique(feature, return_inverse=True)
        products = np.zeros((len(rows), len(rows)))
        by = np.argsort(feature, kind="stable")
        row, feature, value = row[by], feature[by], value[by]
        for low in range(0, len(used), FEATURES):  # some columns of the rows' matrix at a time
            lo, hi = np.searchsorted(feature, (low, low + FEATURES))
            x = np.zeros((len(rows), FEATURES), dtype=np.float32)
            x[row[lo:hi], feature[lo:hi] - low] = value[lo:hi]
            products += x @ x.T
        y = np.array([r[2] for r in rows], dtype=float)
        each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        self.width, self.offset = width, -float(np.log(PRIOR - 1))
        share = np.zeros(len(rows))  # the weights are x' share
        for _ in range(steps):
            own = products @ share
            p = 1 / (1 + np.exp(-(own + self.offset)))
            curve = np.maximum(p * (1 - p), 1e-6)
            share = np.linalg.solve(products + np.diag(penalty / (each * curve)), own + (y - p) / curve)
        self.weights = np.zeros(width, dtype=np.float32)
        self.weights[used] = np.bincount(feature, weights=value * share[row], minlength=len(used))

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """How likely each address is one to block."""
        out, at = np.zeros(len(hosts)), 0
        while at < len(hosts):
            upto, size = at, 0
            while upto < len(hosts) and (size < BLOCK or upto == at):
                size += len(hosts[upto]) + len(paths[upto])
                upto += 1
            row, feature, value = grams(hosts[at:upto], paths[at:upto], width=self.width)
            out[at:upto] = np.bincount(row, weights=self.weights[feature] * value, minlength=upto - at)
            at = upto
        return 1 / (1 + np.exp(-(out + self.offset)))

    def score(self, host: str, path: str) -> float:
        return float(self.scores([host], [path])[0])


def split_url(url):
    """Columns host and path of a URL column; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return host, path


def rule_for(host, path, rules: Sequence[tuple[str, str, str]] = RULES):
    """Columns rule and verdict of the longest rule that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judge_urls(df: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None, cut: float = CUT) -> DataFrame:
    """df with host, path, rule, block_score and verdict. The model is of fixed size and broadcast."""
    short_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model or UrlModel())

    @F.pandas_udf("double")
    def block_score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(shared.value.scores(list(hosts), list(paths)), dtype="float64")

    df, url_col = aside(df, ["host", "path", "rule", "block_score", "verdict"], url_col)
    host, path = split_url(F.col(f"`{url_col}`"))
    out = df.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", rule).withColumn("block_score", block_score("host", "path"))
    by_method = F.when(F.col("block_score") >= cut, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(verdict, by_method))
