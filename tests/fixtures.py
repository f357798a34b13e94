"""Small networks with known results. Fixed values."""


def _network(count, arcs, names=None, end="\n", weight="1"):
    names = names or [f"Node {i}" for i in range(1, count + 1)]
    lines = [f"*Vertices {count}", *[f'{i} "{name}" ' for i, name in enumerate(names, 1)]]
    lines += [f"*Arcs {len(arcs)}", *[f"{a} {b} {weight}" for a, b in arcs]]
    return end.join(lines)


def _both_ways(pairs):
    return [*pairs, *[(b, a) for a, b in pairs]]


# Five nodes, each link with its reverse, line feeds.
FIVE = _network(5, _both_ways([(1, 2), (2, 3), (2, 4), (3, 5), (4, 5)]), list("ABCDE")) + "\n"
FIVE_RANK = {
    "1": 0.11333171162635886,
    "2": 0.294111923387148,
    "3": 0.197388198240875,
    "4": 0.197388198240875,
    "5": 0.1977799685047432,
}
FIVE_IN_DEGREE = {"1": 1, "2": 3, "3": 2, "4": 2, "5": 2}
FIVE_BETWEENNESS = {"1": 0.0, "2": 7.0, "3": 2.0, "4": 2.0, "5": 1.0}

# Fifteen nodes, truly directed, CRLF, no line end after the last line.
CLASSIC = _network(
    15,
    [
        (1, 4), (1, 6), (2, 1), (2, 3), (3, 1), (3, 4), (4, 5), (5, 1), (6, 2), (6, 5), (6, 7), (7, 8), (7, 12),
        (8, 10), (8, 11), (9, 8), (10, 9), (11, 7), (11, 10), (12, 13), (12, 14), (13, 14), (14, 15), (15, 6),
        (15, 12),
    ],
    end="\r\n",
)
CLASSIC_RANK = {
    "1": 0.1151250530665521,
    "2": 0.0348199461285448,
    "3": 0.02479847710463154,
    "4": 0.06946750032275317,
    "5": 0.0938673214028849,
    "6": 0.08759980986545235,
    "7": 0.055954730699145985,
    "8": 0.09347977616941845,
    "9": 0.07023413602621338,
    "10": 0.07086368944260404,
    "11": 0.04972890487200285,
    "12": 0.062452422859304635,
    "13": 0.03654227971520448,
    "14": 0.06760321747312828,
    "15": 0.067462734852159,
}
CLASSIC_BETWEENNESS = {
    "1": 53.83333333333333,
    "2": 24.666666666666668,
    "3": 4.166666666666667,
    "4": 2.1666666666666665,
    "5": 21.33333333333333,
    "6": 117.83333333333333,
    "7": 105.0,
    "8": 58.0,
    "9": 13.0,
    "10": 13.0,
    "11": 33.0,
    "12": 66.0,
    "13": 0.0,
    "14": 66.0,
    "15": 66.0,
}

# Fifteen nodes, each link with its reverse, CRLF, a blank line at the end.
FAMILIES = _network(
    15,
    _both_ways([
        (1, 9), (2, 6), (2, 7), (2, 9), (3, 5), (3, 9), (4, 7), (4, 11), (4, 14), (5, 11), (5, 14), (7, 8), (7, 15),
        (9, 12), (9, 13), (9, 15), (10, 13), (11, 14), (12, 14), (12, 15),
    ]),
    end="\r\n",
    weight="1.0",
) + "\r\n\r\n"
FAMILIES_RANK = {
    "1": 0.0306574373746546,
    "2": 0.0791222528637724,
    "3": 0.05030098711250973,
    "4": 0.068861795613647,
    "5": 0.069330175545371,
    "6": 0.03241797164473548,
    "7": 0.09839783336984746,
    "8": 0.030909539591092605,
    "9": 0.14581720499756173,
    "10": 0.03605387222579755,
    "11": 0.06787531001372168,
    "12": 0.06957426654213783,
    "13": 0.06130322876658256,
    "14": 0.0880984385192153,
    "15": 0.07127968581935294,
}
FAMILIES_BETWEENNESS = {
    "1": 0.0,
    "2": 38.666666666666664,
    "3": 17.0,
    "4": 19.0,
    "5": 10.0,
    "6": 0.0,
    "7": 46.33333333333333,
    "8": 0.0,
    "9": 95.0,
    "10": 0.0,
    "11": 4.0,
    "12": 20.666666666666664,
    "13": 26.0,
    "14": 18.666666666666664,
    "15": 16.666666666666668,
}
