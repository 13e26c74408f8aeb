import ipaddress
import random

from mailsieve.operators import networks


def longest(ip, nets):
    try:
        address = ipaddress.ip_address(ip)
    except ValueError:
        return None
    fits = []
    for n in nets:
        try:
            net = ipaddress.ip_network(n, strict=False)
        except ValueError:
            continue
        if net.version == address.version and address in net:
            fits.append((-net.prefixlen, n))
    return min(fits)[1] if fits else None


def test_equals_the_address_library(spark):
    r = random.Random(1)
    v4 = lambda: ".".join(str(r.choice([0, 1, 10, 127, 128, 255, r.randrange(256)])) for _ in range(4))
    v6 = lambda: ":".join(f"{r.choice([0, 1, 0xffff, 0x8000, 0x2001]):x}" for _ in range(8))
    ips = [v4() for _ in range(150)] + [v6() for _ in range(100)] + ["::", "::1", "2001:db8::", "1::8000", "", "1.2.3", "300.1.1.1", "x", None]
    nets = [f"{v4()}/{r.randrange(33)}" for _ in range(60)] + [f"{v6()}/{r.randrange(129)}" for _ in range(60)]
    nets += [r.choice(ips[:250]) for _ in range(20)] + ["1.1.1.1/33", "::/129", "::1/999999999999", "1.2.3.4/", "nonsense", "0.0.0.0/1", "8000::/1", "::/3"]
    nets = sorted(set(nets))
    rows = spark.createDataFrame([(k, ip, 7, "p") for k, ip in enumerate(ips + ips[:9])], "k long, ip string, wide int, prefix string")
    found = networks.match_networks(rows, spark.createDataFrame([(n, n.upper()) for n in nets], "network string, owner string"))
    got = {x.k: (x.network, x.owner) for x in found.collect()}
    assert len(got) == len(ips) + 9 and found.columns == ["k", "ip", "wide", "prefix", "network", "owner"]
    for k, ip in enumerate(ips + ips[:9]):
        want = longest(ip, nets) if ip else None
        assert got[k] == (want, want and want.upper()), ip


def test_empty_tables(spark):
    rows = spark.createDataFrame([(1, "1.2.3.4")], "k long, ip string")
    nets = spark.createDataFrame([("1.0.0.0/8",)], "network string")
    assert networks.match_networks(rows, nets.limit(0)).collect()[0].network is None
    assert networks.match_networks(rows.limit(0), nets).count() == 0


def test_plan_joins_by_equality(spark):
    rows = spark.range(1000).selectExpr("id", "concat('10.0.', id % 250, '.', id % 7) ip")
    nets = spark.range(300).selectExpr("concat('10.0.', id % 250, '.0/', 8 + id % 20) network")
    found = networks.match_networks(rows, nets)
    assert found.where("network is not null").count() == 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
