"""The reference's whole tables and branches, against lists written apart from the code."""

from sparkveil.operators import records, webintel


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def test_analytics_ids(spark):
    ids = {
        "ga": "UA-12345-1", "ga4": "G-ABCDEF12", "gtm": "GTM-ABC12", "adsense": "pub-1234567890123456", "ads": "AW-123456789", "facebook_pixel": "1234567890123", "hotjar": "12345",
        "yandex_metrika": "1234567", "matomo": "42", "clarity": "abcdefgh12", "segment": "A" * 32, "linkedin_insight": "98765", "tiktok_pixel": "C" * 20, "amazon_associates": "shop-name-21",
    }
    around = {
        "facebook_pixel": "fbq('init', '{}')", "hotjar": "hjid:{},", "yandex_metrika": "ym({}, 'init')", "matomo": "_paq.push(['setSiteId', '{}'])", "clarity": "https://clarity.ms/tag/{}",
        "segment": "cdn.segment.com/analytics.js/v1/{}/a.js", "linkedin_insight": "_linkedin_partner_id = '{}'", "tiktok_pixel": "ttq.load('{}')", "amazon_associates": "https://a.example/?tag={}",
    }
    df = pages(spark, *[around.get(k, " {} ").format(v) for k, v in ids.items()])
    assert sorted((r.page_id, r.provider, r.id) for r in webintel.analytics_ids(df).collect()) == [(i, k, v) for i, (k, v) in enumerate(ids.items())]


def test_profiles(spark):
    links = [
        ("https://github.com/Ann", "github", "ann"), ("https://x.com/ann", "twitter", "ann"), ("https://www.linkedin.com/company/acme", "linkedin", "acme"), ("https://facebook.com/ann.b", "facebook", "ann.b"),
        ("https://instagram.com/ann", "instagram", "ann"), ("https://www.youtube.com/@ann", "youtube", "ann"), ("https://tiktok.com/@ann", "tiktok", "ann"), ("https://t.me/ann", "telegram", "ann"),
        ("https://old.reddit.com/user/ann", "reddit", "ann"), ("https://medium.com/@ann", "medium", "ann"), ("https://threads.net/@ann", "threads", "ann"), ("https://bsky.app/profile/ann.example", "bluesky", "ann.example"),
        ("https://social.example/@ann", "mastodon", "ann@social.example"), ("https://pinterest.com/ann", "pinterest", "ann"), ("https://keybase.io/ann", "keybase", "ann"),
    ]
    df = pages(spark, *[f'<a href="{x[0]}">' for x in links], "https://facebook.com/sharer https://x.com/intent/a")
    assert sorted((r.page_id, r.site, r.username) for r in webintel.profiles(df, "page_id", "html").collect()) == [(i, s, u) for i, (_, s, u) in enumerate(links)]


def test_frameworks(spark):
    marks = {
        "WordPress": "/wp-includes/", "Drupal": "/sites/default/", "Joomla": "/media/jui/", "Ghost": "/ghost/", "Magento": "Magento_", "Shopify": "cdn.shopify.com", "Wix": "static.wixstatic.com", "Squarespace": "static.squarespace.com",
        "Next.js": "__NEXT_DATA__", "Nuxt.js": "/_nuxt/", "Gatsby": "___gatsby", "Angular": "ng-version='17.1'", "React": "react-dom.js", "Vue.js": "__vue__", "jQuery": "jquery.js", "Bootstrap": "bootstrap.css",
        "Laravel": "laravel_session", "Django": "csrfmiddlewaretoken", "Ruby on Rails": "name='csrf-param' content='authenticity_token", "Cloudflare": "/cdn-cgi/",
    }
    df = pages(spark, *marks.values(), '<meta name="generator" content="WordPress 6.2 - x">/wp-content/')
    got = sorted((r.page_id, r.product, r.version) for r in webintel.frameworks(df).collect())
    assert [x[:2] for x in got] == [*enumerate(marks), (20, "WordPress")] and got[20][2] == "6.2" and got[11][2] == "17.1"


def test_error_strings(spark):
    messages = [
        ("postgresql", "ERROR:  syntax error at or near"), ("oracle", "ORA-00942"), ("sql server", "Unclosed quotation mark after"), ("sqlite", "sqlite3.OperationalError"), ("odbc", "ODBC Driver"),
        ("asp.net", "Server Error in '/' Application"), ("ruby", "(NoMethodError)"), ("node.js", "at run (/app/x.js:1:2)"), ("java", "java.lang.NullPointerException"), ("path", "/var/www/site"),
        ("config", "API_KEY="), ("php", "Notice: x in /a.php"), ("php", "Stack trace: #0 "), ("python", "Traceback (most recent call last):"), ("sql", "You have an error in your SQL syntax"), ("java", "at a.B.c(B.java:3)"),
    ]
    df = pages(spark, *[m for _, m in messages], "Warning: mysql_query() in /var/www/a.php on line 3")
    got = {(r.page_id, r.kind) for r in webintel.error_strings(df, "page_id", "html").collect()}
    assert got == {*[(i, k) for i, (k, _) in enumerate(messages)], (16, "php"), (16, "path")}


def test_takeovers(spark):
    cases = [
        ("a.github.io", False, "there isn't a github pages site here."), ("a.s3.amazonaws.com", False, "NoSuchBucket"), ("a.herokuapp.com", True, None), ("a.fastly.net", False, "Fastly error: unknown domain"),
        ("a.bitbucket.io", True, None), ("a.myshopify.com", False, "Sorry, this shop is currently unavailable"), ("a.ghost.io", False, "The thing you were looking for is no longer here"), ("a.surge.sh", False, "project not found"),
        ("a.pantheonsite.io", False, "The gods are wise"), ("domains.a.domains.tumblr.com", False, "Whatever you were looking for doesn't currently exist at this address"), ("a.zendesk.com", False, "Help Center Closed"),
        ("a.readthedocs.io", True, None), ("a.wordpress.com", False, "Do you want to register"), ("a.github.io", True, None), ("a.test", True, "NoSuchBucket"),
    ]
    df = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cases)], "host string, cname string, missing boolean, body string")
    assert {int(r.host): r.confidence for r in webintel.takeovers(df).collect()} == {i: 0.9 if c[1] else 0.95 for i, c in enumerate(cases[:13])}


def test_countries_and_calling_codes(spark):
    df = pages(spark, "Italy and the Netherlands, Papua New Guinea", "Côte d'Ivoire, U.S. and italy", "Omania")
    assert sorted((r.page_id, r.country) for r in records.countries_mentioned(df, "page_id", "html").collect()) == [(0, "IT"), (0, "NL"), (0, "PG"), (1, "CI"), (1, "IT"), (1, "US")]
    numbers = {"+39 06": "IT", "+1 416 5": "CA", "+1 212": "US", "+1 876": "JM", "+7 701": "KZ", "+7 495": "RU", "+86 10": "CN", "+972 3": "IL", "+999": None}
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert {r[0]: r[1] for r in df.select("n", records.phone_country(df["n"])).collect()} == numbers


def test_persons(spark):
    df = pages(spark, '<meta name="author" content="Ann Lee">By Ann Lee', "<meta content='Bo Hay' name='author'>", '{"author": {"@type": "Person", "name": "Cy Dee"}}', '<a rel="author" href="/x"><b>Di Eve</b></a>', "By Jane Q. O'Brien today", "By Admin. By: 007")
    assert sorted((r.page_id, r.name, r.confidence) for r in records.persons(df, "page_id", "html").collect()) == [
        (0, "Ann Lee", 0.75), (1, "Bo Hay", 0.75), (2, "Cy Dee", 0.75), (3, "Di Eve", 0.75), (4, "Jane Q. O'Brien", 0.55),
    ]


def test_linked_files(spark):
    exts = "pdf doc docx xls xlsx ppt pptx odt ods odp rtf csv txt xml json sql bak log zip gz tgz tar rar 7z exe msi dmg iso apk env config ini yml yaml epub mobi kml kmz".split()
    df = spark.createDataFrame([(1, f"/a.{e}?x=1", i) for i, e in enumerate([*exts, "html"])], "page_id long, target string, place int")
    assert records.linked_files(df).count() == 38
