"""Extension: the salience memory over a stream of messages, with the state of each conversation kept by Structured Streaming."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def salience_stream(messages: DataFrame, conv: str = "conv", turn: str = "turn", text: str = "text", decay: float = 0.9) -> DataFrame:
    """(conv, turn, pos, score) of each message as it arrives; messages of one batch are taken in order of turn. Scores are those of
    operators.memory.salience over the messages seen so far, so they are those of the batch form if batches arrive in the order of turns;
    a message that comes late is scored after those that came before it. The state holds token counts and the last message's tokens."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, freq, last = (0, Counter(), [])
        if state.exists:
            pos, blob, tail = state.get
            freq, last = Counter(json.loads(blob)), json.loads(tail)
        rows = pd.concat(list(frames)).sort_values(turn)
        out = []
        for t, s in zip(rows[turn], rows[text]):
            if not isinstance(s, str) or s == "":
                continue
            pos += 1
            toks = [x.lower() for x in s.split()]
            score = 0.0
            if toks:
                rare = sum(1 / (1 + freq[x]) for x in toks) / len(toks)
                new = 1 - len(set(toks) & set(last)) / len(toks)
                score = (rare * (1 + 0.15 * max(s.count("."), s.count("\n"), 1)) * (1 + 0.5 * new) + min(len(toks) / 20, 2.0)) * decay**pos
            freq.update(toks)
            last = toks
            out.append((key[0], t, pos, round(score, 6)))
        state.update((pos, json.dumps(freq), json.dumps(last)))
        yield pd.DataFrame(out, columns=["conv", "turn", "pos", "score"])

    kinds = dict(messages.dtypes)
    return messages.groupBy(conv).applyInPandasWithState(
        step, f"conv {kinds[conv]}, turn {kinds[turn]}, pos bigint, score double", "pos bigint, freq string, last string", "append", GroupStateTimeout.NoTimeout
    )
