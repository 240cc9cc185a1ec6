"""The catalog of 101 published formulaic factors.

Fixed values: the formulas and their numbers are those of the published list. Inputs are columns of a panel: open, high,
low, close, volume, amount, vwap, returns, cap, and the labels subindustry, industry and sector.
"""

from panelyard.functions.formula import (
    X, abs_, adv, col, correlation, covariance, decay_linear, delay, delta, greatest, indneutralize, least, log, product, rank, scale, sign,
    signedpower, stddev, ts_argmax, ts_argmin, ts_max, ts_half_mean, ts_mean, ts_min, ts_rank, ts_sum, where,
)

open_, high, low, close, volume, vwap, returns, cap = (col(c) for c in ("open", "high", "low", "close", "volume", "vwap", "returns", "cap"))

FORMULAS: dict[int, X] = {
    1: rank(ts_argmax(signedpower((where(returns < 0, stddev(returns, 20), close)), 2), 5))-0.5,
    2: -1*correlation(rank(delta(log(volume), 2)), rank((close-open_)/open_), 6),
    3: -1*correlation(rank(open_), rank(volume), 10),
    4: -1*ts_rank(rank(low), 9),
    5: rank(open_-ts_sum(vwap, 10)/10)*(-1*abs_(rank(close-vwap))),
    6: -1*correlation(open_, volume, 10),
    7: where(adv(20)<volume, -1*ts_rank(abs_(delta(close, 7)), 60)*sign(delta(close, 7)), -1),
    8: -1*rank(ts_sum(open_, 5)*ts_sum(returns, 5)-delay(ts_sum(open_, 5)*ts_sum(returns, 5), 10)),
    9: where(0<ts_min(delta(close, 1), 5), delta(close, 1), (where(ts_max(delta(close, 1), 5)<0, delta(close, 1), -delta(close, 1)))),
    10: rank(where(0<ts_min(delta(close, 1), 4), delta(close, 1), (where(ts_max(delta(close, 1), 4)<0, delta(close, 1), -delta(close, 1))))),
    11: (rank(ts_max(vwap-close, 3))+rank(ts_min(vwap-close, 3)))*rank(delta(volume, 3)),
    12: sign(delta(volume, 1))*(-1*delta(close, 1)),
    13: -1*rank(covariance(rank(close), rank(volume), 5)),
    14: -1*rank(delta(returns, 3))*correlation(open_, volume, 10),
    15: -1*ts_sum(rank(correlation(rank(high), rank(volume), 3)), 3),
    16: -1*rank(covariance(rank(high), rank(volume), 5)),
    17: -1*rank(ts_rank(close, 10))*rank(delta(delta(close, 1), 1))*rank(ts_rank(volume/adv(20), 5)),
    18: -1*rank(stddev(abs_(close-open_), 5)+(close-open_)+correlation(close, open_, 10)),
    19: -1*sign((close-delay(close, 7))+delta(close, 7))*(1+rank(1+ts_sum(returns, 250))),
    20: -1*rank(open_-delay(high, 1))*rank(open_-delay(close, 1))*rank(open_-delay(low, 1)),
    21: where(ts_sum(close, 8)/8+stddev(close, 8)<ts_sum(close, 2)/2, -1, (where(ts_sum(close, 2)/2<ts_sum(close, 8)/8-stddev(close, 8), 1, (where(1<=volume/adv(20), 1, -1))))),
    22: -1*delta(correlation(high, volume, 5), 5)*rank(stddev(close, 20)),
    23: where(ts_sum(high, 20)/20<high, -1*delta(high, 2), 0),
    24: where(delta(ts_sum(close, 100)/100, 100)/delay(close, 100)<=0.05, -1*(close-ts_min(close, 100)), -1*delta(close, 3)),
    25: rank(-1*returns*adv(20)*vwap*(high-close)),
    26: -1*ts_max(correlation(ts_rank(volume, 5), ts_rank(high, 5), 5), 3),
    27: where(0.5<rank(ts_sum(correlation(rank(volume), rank(vwap), 6), 2)/2), -1, 1),
    28: scale(correlation(adv(20), low, 5)+(high+low)/2-close),
    29: least(product(rank(rank(scale(log(ts_sum(ts_min(rank(rank(-1*rank(delta(close-1, 5)))), 2), 1))))), 1), 5)+ts_rank(delay(-returns, 6), 5),
    30: (1-rank(sign(close-delay(close, 1))+sign(delay(close, 1)-delay(close, 2))+sign(delay(close, 2)-delay(close, 3))))*ts_sum(volume, 5)/ts_sum(volume, 20),
    31: rank(rank(rank(decay_linear(-1*rank(rank(delta(close, 10))), 10))))+rank(-1*delta(close, 3))+sign(scale(correlation(adv(20), low, 12))),
    32: scale(ts_sum(close, 7)/7-close)+20*scale(correlation(vwap, delay(close, 5), 230)),
    33: rank(-1*(1-open_/close)**1),
    34: rank((1-rank(stddev(returns, 2)/stddev(returns, 5)))+(1-rank(delta(close, 1)))),
    35: ts_rank(volume, 32)*(1-ts_rank(close+high-low, 16))*(1-ts_rank(returns, 32)),
    36: 2.21*rank(correlation(close-open_, delay(volume, 1), 15))+0.7*rank(open_-close)+0.73*rank(ts_rank(delay(-returns, 6), 5))+rank(abs_(correlation(vwap, adv(20), 6)))+0.6*rank((ts_sum(close, 200)/200-open_)*(close-open_)),
    37: rank(correlation(delay(open_-close, 1), close, 200))+rank(open_-close),
    38: -1*rank(ts_rank(close, 10))*rank(close/open_),
    39: -1*rank(delta(close, 7)*(1-rank(decay_linear(volume/adv(20), 9))))*(1+rank(ts_sum(returns, 250))),
    40: -1*rank(stddev(high, 10))*correlation(high, volume, 10),
    41: (high*low)**0.5-vwap,
    42: rank(vwap-close)/rank(vwap+close),
    43: ts_rank(volume/adv(20), 20)*ts_rank(-1*delta(close, 7), 8),
    44: -1*correlation(high, rank(volume), 5),
    45: -1*rank(ts_sum(delay(close, 5), 20)/20)*correlation(close, volume, 2)*rank(correlation(ts_sum(close, 5), ts_sum(close, 20), 2)),
    46: where(0.25<((delay(close, 20)-delay(close, 10))/10-(delay(close, 10)-close)/10), -1, (where(((delay(close, 20)-delay(close, 10))/10-(delay(close, 10)-close)/10)<0, 1, -1*(close-delay(close, 1))))),
    47: rank(1/close)*volume/adv(20)*high*rank(high-close)/(ts_sum(high, 5)/5)-rank(vwap-delay(vwap, 5)),
    48: indneutralize(correlation(delta(close, 1), delta(delay(close, 1), 1), 250)*delta(close, 1)/close, "subindustry")/ts_sum((delta(close, 1)/delay(close, 1))**2, 250),
    49: where(((delay(close, 20)-delay(close, 10))/10-(delay(close, 10)-close)/10)<-0.1, 1, -1*(close-delay(close, 1))),
    50: -1*ts_max(rank(correlation(rank(volume), rank(vwap), 5)), 5),
    51: where(((delay(close, 20)-delay(close, 10))/10-(delay(close, 10)-close)/10)<-0.05, 1, -1*(close-delay(close, 1))),
    52: (-1*ts_min(low, 5)+delay(ts_min(low, 5), 5))*rank((ts_sum(returns, 240)-ts_sum(returns, 20))/220)*ts_rank(volume, 5),
    53: -1*delta(((close-low)-(high-close))/(close-low), 9),
    54: -1*(low-close)*(open_**5)/((low-high)*(close**5)),
    55: -1*correlation(rank((close-ts_min(low, 12))/(ts_max(high, 12)-ts_min(low, 12))), rank(volume), 6),
    56: -1*rank(ts_sum(returns, 10)/ts_sum(ts_sum(returns, 2), 3))*rank(returns*cap),
    57: -1*(close-vwap)/decay_linear(rank(ts_argmax(close, 30)), 2),
    58: -1*ts_rank(decay_linear(correlation(indneutralize(vwap, "sector"), volume, 3.92795), 7.89291), 5.50322),
    59: -1*ts_rank(decay_linear(correlation(indneutralize(vwap*0.728317+vwap*(1-0.728317), "industry"), volume, 4.25197), 16.2289), 8.19648),
    60: -1*(2*scale(rank((((close-low)-(high-close))/(high-low))*volume))-scale(rank(ts_argmax(close, 10)))),
    61: rank(vwap-ts_min(vwap, 16.1219))<rank(correlation(vwap, adv(180), 17.9282)),
    62: -1*(rank(correlation(vwap, ts_sum(adv(20), 22.4101), 9.91009))<rank((rank(open_)+rank(open_))<(rank((high+low)/2)+rank(high)))),
    63: -1*(rank(decay_linear(delta(indneutralize(close, "industry"), 2.25164), 8.22237))-rank(decay_linear(correlation(vwap*0.318108+open_*(1-0.318108), ts_sum(adv(180), 37.2467), 13.557), 12.2883))),
    64: -1*(rank(correlation(ts_sum(open_*0.178404+low*(1-0.178404), 12.7054), ts_sum(adv(120), 12.7054), 16.6208))<rank(delta(((high+low)/2)*0.178404+vwap*(1-0.178404), 3.69741))),
    65: -1*(rank(correlation(open_*0.00817205+vwap*(1-0.00817205), ts_sum(adv(60), 8.6911), 6.40374))<rank(open_-ts_min(open_, 13.635))),
    66: -1*(rank(decay_linear(delta(vwap, 3.51013), 7.23052))+ts_rank(decay_linear((low-vwap)/(open_-(high+low)/2), 11.4157), 6.72611)),
    67: -1*(rank(high-ts_min(high, 2.14593))**rank(correlation(indneutralize(vwap, "sector"), indneutralize(adv(20), "subindustry"), 6.02936))),
    68: -1*(ts_rank(correlation(rank(high), rank(adv(15)), 8.91644), 13.9333)<rank(delta(close*0.518371+low*(1-0.518371), 1.06157))),
    69: -1*(rank(ts_max(delta(indneutralize(vwap, "industry"), 2.72412), 4.79344))**ts_rank(correlation(close*0.490655+vwap*(1-0.490655), adv(20), 4.92416), 9.0615)),
    70: -1*(rank(delta(vwap, 1.29456))**ts_rank(correlation(indneutralize(close, "industry"), adv(50), 17.8256), 17.9171)),
    71: greatest(ts_rank(decay_linear(correlation(ts_rank(close, 3.43976), ts_rank(adv(180), 12.0647), 18.0175), 4.20501), 15.6948), ts_rank(decay_linear(rank(low+open_-vwap-vwap)**2, 16.4662), 4.4388)),
    72: rank(decay_linear(correlation((high+low)/2, adv(40), 8.93345), 10.1519))/rank(decay_linear(correlation(ts_rank(vwap, 3.72469), ts_rank(volume, 18.5188), 6.86671), 2.95011)),
    73: -1*greatest(rank(decay_linear(delta(vwap, 4.72775), 2.91864)), ts_rank(decay_linear(-1*delta(open_*0.147155+low*(1-0.147155), 2.03608)/(open_*0.147155+low*(1-0.147155)), 3.33829), 16.7411)),
    74: -1*(rank(correlation(close, ts_sum(adv(30), 37.4843), 15.1365))<rank(correlation(rank(high*0.0261661+vwap*(1-0.0261661)), rank(volume), 11.4791))),
    75: rank(correlation(vwap, volume, 4.24304))<rank(correlation(rank(low), rank(adv(50)), 12.4413)),
    76: -1*greatest(rank(decay_linear(delta(vwap, 1.24383), 11.8259)), ts_rank(decay_linear(ts_rank(correlation(indneutralize(low, "sector"), adv(81), 8.14941), 19.569), 17.1543), 19.383)),
    77: least(rank(decay_linear((high+low)/2-vwap, 20.0451)), rank(decay_linear(correlation((high+low)/2, adv(40), 3.1614), 5.64125))),
    78: rank(correlation(ts_sum(low*0.352233+vwap*(1-0.352233), 19.7428), ts_sum(adv(40), 19.7428), 6.83313))**rank(correlation(rank(vwap), rank(volume), 5.77492)),
    79: rank(delta(indneutralize(close*0.60733+open_*(1-0.60733), "sector"), 1.23438))<rank(correlation(ts_rank(vwap, 3.60973), ts_rank(adv(150), 9.18637), 14.6644)),
    80: -1*(rank(sign(delta(indneutralize(open_*0.868128+high*(1-0.868128), "industry"), 4.04545)))**ts_rank(correlation(high, adv(10), 5.11456), 5.53756)),
    81: -1*(rank(log(product(rank(rank(correlation(vwap, ts_sum(adv(10), 49.6054), 8.47743))**4), 14.9655)))<rank(correlation(rank(vwap), rank(volume), 5.07914))),
    82: -1*least(rank(decay_linear(delta(open_, 1.46063), 14.8717)), ts_rank(decay_linear(correlation(indneutralize(volume, "sector"), open_, 17.4842), 6.92131), 13.4283)),
    83: rank(delay((high-low)/(ts_sum(close, 5)/5), 2))*rank(rank(volume))/(((high-low)/(ts_sum(close, 5)/5))/(vwap-close)),
    84: signedpower(ts_rank(vwap-ts_max(vwap, 15.3217), 20.7127), delta(close, 4.96796)),
    85: rank(correlation(high*0.876703+close*(1-0.876703), adv(30), 9.61331))**rank(correlation(ts_rank((high+low)/2, 3.70596), ts_rank(volume, 10.1595), 7.11408)),
    86: -1*(ts_rank(correlation(close, ts_sum(adv(20), 14.7444), 6.00049), 20.4195)<rank(close-vwap)),
    87: -1*greatest(rank(decay_linear(delta(close*0.369701+vwap*(1-0.369701), 1.91233), 2.65461)), ts_rank(decay_linear(abs_(correlation(indneutralize(adv(81), "industry"), close, 13.4132)), 4.89768), 14.4535)),
    88: least(rank(decay_linear(rank(open_)+rank(low)-rank(high)-rank(close), 8.06882)), ts_rank(decay_linear(correlation(ts_rank(close, 8.44728), ts_rank(adv(60), 20.6966), 8.01266), 6.65053), 2.61957)),
    89: ts_rank(decay_linear(correlation(low, adv(10), 6.94279), 5.51607), 3.79744)-ts_rank(decay_linear(delta(indneutralize(vwap, "industry"), 3.48158), 10.1466), 15.3012),
    90: -1*(rank(close-ts_max(close, 4.66719))**ts_rank(correlation(indneutralize(adv(40), "subindustry"), low, 5.38375), 3.21856)),
    91: -1*(ts_rank(decay_linear(decay_linear(correlation(indneutralize(close, "industry"), volume, 9.74928), 16.398), 3.83219), 4.8667)-rank(decay_linear(correlation(vwap, adv(30), 4.01303), 2.6809))),
    92: least(ts_rank(decay_linear(((high+low)/2+close)<(low+open_), 14.7221), 18.8683), ts_rank(decay_linear(correlation(rank(low), rank(adv(30)), 7.58555), 6.94024), 6.80584)),
    93: ts_rank(decay_linear(correlation(indneutralize(vwap, "industry"), adv(81), 17.4193), 19.848), 7.54455)/rank(decay_linear(delta(close*0.524434+vwap*(1-0.524434), 2.77377), 16.2664)),
    94: -1*(rank(vwap-ts_min(vwap, 11.5783))**ts_rank(correlation(ts_rank(vwap, 19.6462), ts_rank(adv(60), 4.02992), 18.0926), 2.70756)),
    95: rank(open_-ts_min(open_, 12.4105))<ts_rank(rank(correlation(ts_sum((high+low)/2, 19.1351), ts_sum(adv(40), 19.1351), 12.8742))**5, 11.7584),
    96: -1*greatest(ts_rank(decay_linear(correlation(rank(vwap), rank(volume), 3.83878), 4.16783), 8.38151), ts_rank(decay_linear(ts_argmax(correlation(ts_rank(close, 7.45404), ts_rank(adv(60), 4.13242), 3.65459), 12.6556), 14.0365), 13.4143)),
    97: -1*(rank(decay_linear(delta(indneutralize(low*0.721001+vwap*(1-0.721001), "industry"), 3.3705), 20.4523))-ts_rank(decay_linear(ts_rank(correlation(ts_rank(low, 7.87871), ts_rank(adv(60), 17.255), 4.97547), 18.5925), 15.7152), 6.71659)),
    98: rank(decay_linear(correlation(vwap, ts_sum(adv(5), 26.4719), 4.58418), 7.18088))-rank(decay_linear(ts_rank(ts_argmin(correlation(rank(open_), rank(adv(15)), 20.8187), 8.62571), 6.95668), 8.07206)),
    99: -1*(rank(correlation(ts_sum((high+low)/2, 19.8975), ts_sum(adv(60), 19.8975), 8.8136))<rank(correlation(low, volume, 6.28259))),
    100: -1*((1.5*scale(indneutralize(indneutralize(rank((((close-low)-(high-close))/(high-low))*volume), "subindustry"), "subindustry"))-scale(indneutralize(correlation(close, rank(adv(20)), 5)-rank(ts_argmin(close, 30)), "subindustry")))*(volume/adv(20))),
    101: (close-open_)/((high-low)+0.001),
}

#: Factors beside the list: displacement from the highest close, and the price impact of traded amounts.
OTHERS: dict[str, X] = {
    "disp": -close / ts_max(close, 20),
    "illiq": ts_half_mean(abs_(returns) / col("amount"), 20),
}


def history(x: X) -> int:
    """How many bars a value of the formula looks back, its own included."""
    below = max((history(a) for a in x.args), default=1)
    if x.op == "lag":
        return below + x.par
    return below + (x.par - 1 if x.op in {"min", "max", "sum", "mean", "std", "product", "argmax", "argmin", "ts_rank", "decay", "corr", "cov", "half_mean"} else 0)
