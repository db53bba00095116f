"""The codes and formats that results must carry."""

ACTION_ADD, ACTION_UPDATE, ACTION_DELETE, ACTION_CLEAR = 1, 2, 3, 4
SIDE_NONE, SIDE_BUY, SIDE_SELL = 0, 1, 2
AGGRESSOR_NONE, AGGRESSOR_BUYER, AGGRESSOR_SELLER = 0, 1, 2
FLAG_LAST = 128

# Spellings of a taker's side in on-chain fills, after lower-casing and '-' -> '_'.
BUY_WORDS = ("buy", "buyer", "bid", "bidder", "taker_buy", "buying")
SELL_WORDS = ("sell", "seller", "ask", "offer", "taker_sell", "selling")

MISSING_FILL_ID = "telonex"
L2_TRADE_ID = "pmxt"
