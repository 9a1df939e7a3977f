"""The labelled urls that the classifier of urls.py learns from, without schemes: labelled by hand, each host and path written on its own.

Hosts of the class to block are invented, but for some advertising and counting services; hosts to allow are public sites, and
invented ones of the kinds that a crawl is full of, among them urls that hold a part of a word to block (essex, raccoon, adsorption).
"""

from __future__ import annotations

#: Adult, gambling, pharmacy, piracy, phishing and malware, advertising and counting, link and loan spam.
BLOCK = """
hotpornclips.xyz/watch/18231 www.freexxxvideos24.com/cat/amateur sexy-girls-live.top/cam/7 nudecelebs.club/gallery/33 adulttube.biz/v/99120.html
escort-paris-vip.com/girls/lena eroticstories.cc/story/my-neighbour xxx-hentai-online.net.ru/manga/5 camgirls4u.live/room/bella milf-dating-now.click/join
www.teenpornhd.pro/free/12 adult-chat-rooms.info/enter naughty-singles.date/signup?x hardcoremovies.porn/new bigboobs-pics.net.in/p/4
erotik-kontakte.de.tl/frauen/berlin videos-porno-gratis.xyz/es/2 sexe-gratuit.top/fr/video-77.html pornodeutsch.ws/film/321 livesexcams.stream/model/ivy
stripclub-tube.xxx/hot/1 fetish-zone.adult/members nudist-cams.vip/live/3 xvideo-downloader.icu/get/8812 sexshop-discount.bid/toys/vibrator
www.royalcasino777.com/bonus best-online-slots.bet/spin poker-star-win.top/register bet365-mirror.xyz/login freespins-nodeposit.casino/offer/20
jackpot-city-games.icu/play roulettewin.club/strategy/1 sportsbetting-odds24.com/live/football lucky-lotto-results.win/claim/900 blackjack-real-money.online/deposit
baccarat-asia88.vip/en/promo slotgacor-maxwin.xyz/daftar kasino-bonus.top/de/ohne-einzahlung apuestas-online-gratis.bet/registro paris-sportif-bonus.click/fr/inscription
bingo-cash-out.win/app megaslots.game/jackpots/daily crypto-gambling.bet/dice/roll wettbonus-24.com/angebot onlinepokies.top/au/free-spins
buy-viagra-cheap.top/order cialis-no-prescription.xyz/20mg online-pharmacy-rx24.com/pills/tramadol cheapmeds-online.biz/cart steroids-for-sale.shop/anabolic/7
weightlosspills-fast.click/buy-now xanax-overnight.store/order.html cbd-gummies-miracle.shop/trial keto-burn-fat.top/special-offer malepower-enhancement.click/order
hgh-supplements-discount.biz/checkout levitra-generic.ru/en/price modafinil-shop.to/buy apotheke-ohne-rezept.top/de/potenzmittel pastillas-adelgazar.xyz/comprar
canadian-drugs-cheap.com/rx/viagra ambien-online.click/cheap phentermine-direct.biz/no-rx testosterone-booster.top/free-trial pillstore24.ru/cart
www.warez-downloads.to/full/photoshop-crack crackedsoft.ws/keygen/windows-10 torrent-mirror.xyz/magnet/44aa moviez-stream-free.top/watch/avatar-full-hd serialkeys.cc/office-2019-activator
nulled-themes.club/wp/download apk-mod-unlimited.icu/coins-hack free-full-movies.stream/hd/1080p pirate-proxy-list.click/browse/200 keygens-archive.to/a/adobe
rapid-leech.biz/dl/9923 patch-serial.download/setup.exe.html epub-pirate.cc/get/bestsellers cracks4all.top/games/fifa-23-crack iptv-free-premium.xyz/m3u/list
leaked-albums.to/mp3/zip rom-dumps.ws/n/pack roblox-free-robux.click/generator steam-wallet-codes.icu/generator/free hack-instagram-account.top/online
secure-paypal-login.verify-account.xyz/signin appleid-locked.support-verify.top/unlock bankofamerica-alert.update-info.click/login.php netflix-billing-update.account-confirm.icu/pay amazon-security-check.ru.com/ap/signin
your-pc-infected.top/call-support microsoft-warning-0x800.xyz/alert update-flash-player.download/install trojan-dropper.ru/payload/a1 wallet-connect-restore.click/seed
free-antivirus-scan.icu/scan.html dhl-parcel-fee.top/track/pay irs-refund-claim.xyz/form metamask-verification.app-login.click/import ebay-user-verify.account-limited.ru/webscr
office365-mailbox-full.click/owa/login malware-host.biz/exploit/kit phish-kit.ru/panel/login.php ransom-decrypt.to/pay/btc keylogger-free.download/setup
irs-gov.refund-status.top/verify/ssn chase-online.secure-login-update.xyz/auth spyware-removal-tool.click/scan covid-relief-payment.top/apply/now botnet-rent.ru/ddos/price
doubleclick.net/ads/click ad.doubleclick.com/pagead/imp pagead2.googlesyndication.com/pagead/js ads.yieldserver.com/banner/728x90 track.clickmeter.biz/redirect/5531
adserver.mediabuy.io/serve/300x250 pixel.trackingstats.com/px.gif popunder-ads.click/pop.js banner-exchange.biz/show/17 affiliate-network.click/aff/c/889
go.clicktracker.xyz/aff_c/offer-12 adnxs.com/getuid counter.hitstat.ru/cnt.gif sponsored-links.biz/out/33 push-notification-ads.top/subscribe
retargeting.adroller.io/beacon/1 stats.webcounter.cc/collect cpm-banners.com/ad/iframe.html ads-delivery.io/adframe/top tracker.emailopens.biz/open/ab12
smartadserver.com/call/pubj/9 taboola-feed.biz/sponsored/widget click.promo-mailer.top/unsubscribe/7 adclick.g.syndicate.io/aclk criteo-like-ads.com/dis/rtb
cheap-payday-loans.click/apply instant-cash-advance.top/no-credit-check earn-money-fast.biz/home-job forex-signals-profit.vip/join binary-options-robot.xyz/free-demo
get-rich-crypto.click/invest/double-btc replica-watches-outlet.shop/rolex fake-id-online.to/order designer-handbags-cheap.top/gucci/sale you-are-winner.click/prize/iphone
free-gift-card.icu/claim/amazon seo-backlinks-cheap.biz/buy/1000-links essay-writing-cheap.top/order-now instagram-followers-buy.click/10k mlm-income-secret.biz/webinar
credit-repair-fast.top/free-quote spam-mailer.ru/bulk/email-list counterfeit-money.to/buy/euro work-from-home-365.click/earn-daily whatsapp-lottery.win/lucky/draw
bitcoin-doubler.top/send free-iphone-giveaway.xyz/survey debt-relief-now.click/quote doorway-pages.biz/buy-cheap/1 casino-guestbook-spam.top/post/55
blog.hotnews.click/sexy-photos/12 forum.oldboard.info/cheap-viagra-online/3 myhomepage.cc/free-porn-movies news.dailyfeed.top/win-casino-bonus www.smallshop.biz/wp-content/buy-cialis-online
files.hostit.to/keygen/crack.zip shop.bargain.click/replica-rolex-sale travel.dealz.top/online-poker-bonus static.widgets.biz/popup/ads.js cdn.medialand.io/banner/click/7
www.grandcasino-online.com/slots/free casinoreviews.co.uk/bonus-codes www.mycasino.de/spielautomaten bestpokersites.org/rakeback m.betting-tips.com/football/odds
www.slotsmania.co.uk/jackpot blog.onlinecasinos.org/welcome-bonus roulette-system.de/gewinnen gamblingsites.co.uk/sports/bets www.bingohall.com/win freebet-club.com/offers
www.pornstarmovies.com/clips sexvideos.co.uk/amateur m.adultfriends.org/profiles/22 www.nakedcelebs.com/photos adult-shop.de/dessous hot-escorts.co.uk/london
blog.xxxreviews.com/top-10 www.sexcontact.de/chat eroticmassage.org/girls pornhubmirror.com/view cam-sex.com/shows adultfilms.fr/gratuit
www.warezforum.com/topic/9 warez-scene.org/releases www.torrentsearch.org/movies/hd torrents.co.uk/download m.crackserial.com/autocad www.keygenworld.org/list
freemovies-online.com/stream/full cracked-apps.com/ios serialz.de/key/office piratedgames.org/pc/full www.mp3pirate.com/album.zip
www.cheapviagra.com/order pillsonline.co.uk/buy m.pharmacyrx.com/no-prescription genericpills.org/cialis www.diet-pills.com/special viagra-apotheke.de/bestellen
buy-steroids.co.uk/shop www.onlinepharmacies.org/meds/price weightloss-pills.com/free-trial
phishing-bank.com/login.php www.paypal-verify.com/account/update secure-login-bank.org/signin malware-download.com/setup.exe www.virus-alert.com/scan fake-antivirus.org/install
trojan-files.com/exe account-suspended.co.uk/verify
ads.newsnetwork.com/banner/12 adserver.publisher.org/click ad-track.com/pixel www.ads-network.com/impression track.adclicks.org/redirect m.adtracker.com/pop tracking.mailads.co.uk/open
banners.adworld.com/300x250 clicks.affiliates.com/go/77 popads.org/under adsystem.co.uk/serve ads.trackers.de/zaehler
www.paydayloan.com/apply quickloans.co.uk/bad-credit win-prizes.com/claim www.fakewatches.org/rolex spamlinks.com/links link-farm.org/page/3 www.freegiveaways.com/win
make-money-fast.com/join replicabags.co.uk/sale buylinks.org/seo www.getrichquick.com/secret spam-comments.de/gaestebuch linkspam.com/farm/8
"""

ALLOW = """
en.wikipedia.org/wiki/Photosynthesis de.wikipedia.org/wiki/Rhein fr.wikipedia.org/wiki/Lyon www.bbc.co.uk/news/science-environment-1234 www.nytimes.com/2021/05/04/world/europe/story.html
www.theguardian.com/books/2019/mar/10/review www.lemonde.fr/economie/article/2020/01/12/titre elpais.com/cultura/2018/07/03/nota.html www.spiegel.de/wissenschaft/artikel-1.html www.reuters.com/markets/commodities/oil
www.nature.com/articles/s41586-020-1 arxiv.org/abs/1706.03762 www.nasa.gov/mission_pages/station/main www.who.int/news-room/fact-sheets/detail/malaria www.cdc.gov/flu/about
www.nhs.uk/conditions/asthma europa.eu/youth/volunteering_en www.gov.uk/renew-driving-licence www.loc.gov/collections/maps www.congress.gov/bill/117th/house-bill/3
github.com/apache/arrow/issues/12 stackoverflow.com/questions/11227809/why-is-it-faster docs.python.org/3/library/asyncio.html developer.mozilla.org/en-US/docs/Web/HTML pypi.org/project/numpy
kernel.org/doc/html/latest/index.html www.gnu.org/philosophy/free-sw.html www.debian.org/releases/stable www.postgresql.org/docs/14/sql-select.html spark.apache.org/docs/latest/tuning.html
www.mit.edu/research web.stanford.edu/class/cs101 www.ox.ac.uk/admissions www.essex.ac.uk/study sussexlibrary.uk/opening-hours
middlesex-hospital.uk/wards/7 www.uni-heidelberg.de/studium www.sorbonne.fr/bibliotheque www.ub.edu/web/ub/es/estudis scunthorpe.gov.uk/council/tax
www.imdb.com/title/tt0111161 archive.org/details/texts www.gutenberg.org/ebooks/1342 www.goodreads.com/book/show/2657 www.poetryfoundation.org/poems/44272
www.allrecipes.com/recipe/23600/lasagna www.chefkoch.de/rezepte/1234/apfelkuchen.html www.marmiton.org/recettes/quiche-lorraine cookingwithherbs.com/blog/thyme-bread sourdoughdiary.net.au/day-3
www.weather.gov/forecast/boston www.wetter.de/deutschland/hamburg meteofrance.com/previsions/nice www.openstreetmap.org/relation/62422 www.nationalgeographic.com/animals/mammals/raccoon
www.rspb.org.uk/birds/robin mushroomhunters.org/species/boletus beekeeping-beginners.info/hives/spring gardenersdiary.co.uk/2014/05/roses treesofthecoast.com/cedar
www.uefa.com/championsleague/fixtures www.cricinfo.com/series/ashes-2019 chessproblems.info/mate-in-two hillwalking-scotland.co.uk/routes/ben-nevis cycleroutes.nl/amsterdam/noord
marathontraining.com/plans/beginner www.tennis-club-bremen.de/verein/termine swimming-lessons.ie/dublin/kids www.olympics.com/en/athletes/results judoschool.fr/horaires
mozart-letters.org/1781/vienna jazzarchive.net.nz/sessions/1959 www.metmuseum.org/art/collection/search/437 www.louvre.fr/visiter/horaires-tarifs filmreviews.co/2012/drama/quiet-river
photographyforum.com/lenses/50mm/thread-88 knittingpatterns.info/scarf/free-pattern woodworkers-guild.org/joints/dovetail oldcameras.de/leica/iii potteryclass.ca/glazes
www.lonelyplanet.com/portugal/lisbon romehostels.it/rooms/prices www.bahn.de/fahrplan/auskunft www.sncf.com/fr/itineraires airportguide.info/zurich/parking
hotel-alpenblick.at/zimmer/preise ferryschedules.gr/piraeus camping-bretagne.fr/tarifs trainspotters.uk/steam/4472 travelnotes.blog/2016/peru/cusco
www.khanacademy.org/math/algebra mathworld.wolfram.com/Circle.html grammarhelp.org/english/past-perfect www.duolingo.com/course/es teachers-lounge.com/lesson-plans/fractions
kids-science.info/experiments/volcano analysis-textbook.edu/chapter/4 assessment-centre.ac.uk/exams/dates classicsdepartment.edu/latin/vergil sextant-navigation.org/history
www.irs.gov/forms-pubs www.ecb.europa.eu/stats/policy_and_exchange_rates worldbank.org/en/country/kenya taxadvice.org.uk/self-assessment creditunion-leeds.co.uk/savings/rates
www.federalreserve.gov/monetarypolicy accountants-lyon.fr/services/paie farmersmarket-vt.com/vendors smallbusiness-guide.org/invoices/template insurancewatch.eu/reports/2019
www.mayoclinic.org/diseases-conditions/asthma/symptoms diabetes-care.org/diet/recipes pharmacology.edu/lectures/beta-blockers pubmed.ncbi.nlm.nih.gov/31415926 nursing-journal.com/issues/12/3
physiotherapy-bern.ch/team dentist-oakville.ca/contact hospice-volunteers.org.uk/join psychologytoday.org/blog/attention therapist-directory.nz/auckland
breastcancer-support.org/stories sexeducation-teachers.org/curriculum/grade-9 reproductive-health.who.int/guidelines adulteducation-leeds.ac.uk/courses/evening adult-literacy.org.au/tutors
adsorption-chemistry.edu/isotherms addressbook-software.de/handbuch adirondack-hiking.org/trails/marcy toadspecies.info/bufo roadsafety.govt.nz/statistics
trackandfield-records.org/100m racetrack-history.com/monza soundtracks-review.net.au/1984 railtrackdiagrams.uk/north trackmaintenance-engineers.org/ballast
bannerman-castle.org/tours spamalot-theatre.co.uk/cast winnersofnobel.info/physics/1921 keystone-species.edu/sea-otter crackle-glaze.info/kiln/raku
nutcracker-ballet.org/tickets serialfiction.net.au/dickens/pickwick pokerface-lyrics.fan/verse slotcar-racing.club/tracks pillbox-forts.org.uk/suffolk
casinopolis-island.gov.pt/historia lotteryfunded-heritage.org.uk/projects betterbread.com/rye alphabet-books.org/a betacarotene.info/carrots
cocktail-recipes.net.au/martini analogclocks.de/modelle titmouse-birds.info/nest cumberland-sausage.co.uk/butcher dickensmuseum.london/visit
docs.oracle.com/javase/8/docs/api rust-lang.org/learn/get-started postgres-weekly.com/issues/400 linuxjournal.com/content/cron forum.arduino.cc/t/servo-motor/1122
freedombox.org/download free-software-foundation.eu/campaigns onlinebooks.library.upenn.edu/authors online-courses.ac.in/syllabus livescience.org/earthquakes
login.university-portal.edu/help account.library.ca/renewals support.printers.com/manuals/laser update-notes.dev/releases/2.1 verify-facts.org/election/claims
promenade-concerts.org.uk/season bonusmaterial.press/chapters/errata clickhouse-docs.org/functions dating-rocks.edu/radiocarbon winterthur.ch/verwaltung
cheapflights-history.info/airlines buyersguide-tractors.com/deere shop.museum.org/postcards order-of-malta.int/history market-garden.co.uk/vegetable-boxes
videoarchive.nfb.ca/documentary livestock-prices.gov.au/cattle girlguides.org.nz/badges teenreads-library.org/reviews singlestrand-dna.edu/lab
smalltown.us/events/parade wendys-quilts.com/blog/2011/03 familytree-smith.info/p/17 villagechurch.org.uk/choir robotics-team-44.org/season
mariasgarden.es/blog/tomates jardin-botanico.es/visitas cuentos-infantiles.org/la-tortuga noticias-locales.com.ar/barrio/plaza biblioteca-nacional.pe/catalogo
handwerk-lexikon.de/tischler kinderbuecher.at/autoren/lindgren wanderwege-harz.de/brocken zeitung-oberland.de/lokales/2018/09 geschichte-der-hanse.de/luebeck
recettes-de-maman.fr/tarte histoire-de-france.fr/revolution/1789 randonnees-alpes.fr/vanoise mairie-quimper.fr/etat-civil journal-du-lac.ch/articles/regate
hvezdarna.cz/program bibliotek.dk/boeger/andersen muzeum-krakow.pl/wystawy sushi-history.jp/edo fado-museum.pt/bilhetes
c.org/ m.news-daily.com/a/1 blog.kestrel.dev/posts/7 www.qorvane.com/en/12 img.lumetta.org/about
tolvik.info/pages/4 www.brunfeld.eu/de/88.html shop.orrelin.co/fr/3 wiki.pandelo.net.br/es/41 static.vesmar.io/en/2020/index.html
oceanwatch.xyz/reefs/coral linear-algebra.xyz/notes/3 chess-club.club/members bookclub.club/april/dune rowing.club/regatta stargazers.top/nebula
mountain-huts.top/route/5 sourcecode.online/lessons/recursion museum-nights.live/programme violin-lessons.online/teachers poetry.click/haiku garden-shed.shop/tools
local-bakery.shop/bread/rye yarn.shop/wool/merino cartography.biz/atlas bricklayers.biz/contact plumbing-parts.biz/valves history-podcast.live/episodes/12
solar-data.icu/panels icu-nursing.info/shifts hospital-icu.org.uk/visiting games-history.ws/pong samoa.ws/tourism chess-openings.game/sicilian
mathvideos.stream/calculus river-stream-ecology.org/insects fly-fishing.vip/knots gov.ru/statistics bolshoi-theatre.ru/en/ballet tolstoy-library.ru/anna
weather-station.download/data/2019 opendata.download/census/csv birdsong.download/recordings/wren tongarchive.to/language/grammar choir.date/rehearsals calendar-history.date/julian
m.gazette.com/politics/budget m.recipes.co.uk/soup blog.carpenter.com/chairs blog.mathteacher.org/fractions www.tracks-and-trails.com/utah videos.university.com/lectures/5
adsl-help.co.uk/router farmstories.com/cows link-library.org/reading betty-bakes.com/scones winemakers.org/burgundy loanwords-linguistics.org/japanese
giftofsight.org/donate free-clinics.org/locations movies.library.org/silent moneymuseum.org/coins onlineatlas.com/rivers buyingahouse.gov.uk/steps
news.townhall.com/world/asia worldnews.org/africa/elections news.harbour.de/welt localnews.co.uk/schools evening-news.com/weather/today
"""


def labelled() -> list[tuple[str, int]]:
    """(url, 1 to block or 0 to allow) of the table. A url without host and path has nothing to block."""
    return [("", 0)] + [(u, y) for y, rows in ((1, BLOCK), (0, ALLOW)) for u in rows.split()]
