"""Entry points for ``spark-submit``.

    jobs.py train   --data DIR --models DIR
    jobs.py predict --data DIR --models DIR --requests FILE --out DIR
    jobs.py evaluate --data DIR --models DIR --out DIR

The data folder holds train.csv, val.csv, business.json, user.json, review_train.json and
checkin.json; names, the lookup file and the name of the sign-up field can be given.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from rateweave.operators import models
from rateweave.operators.features import Sources
from rateweave.operators.ratings import PAIR
from rateweave.plans.pipeline import evaluate_predictions, predict, train_models
from rateweave.session import build_session
from rateweave.sources import readers, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Hybrid rating prediction")
    p.add_argument("job", choices=["train", "predict", "evaluate"])
    p.add_argument("--data", required=True)
    p.add_argument("--models", required=True)
    p.add_argument("--requests")
    p.add_argument("--out")
    p.add_argument("--train-file", default="train.csv")
    p.add_argument("--val-file", default="val.csv")
    p.add_argument("--items-file", default="business.json")
    p.add_argument("--users-file", default="user.json")
    p.add_argument("--reviews-file", default="review_train.json")
    p.add_argument("--checkins-file", default="checkin.json")
    p.add_argument("--lookup", help="JSON object from lower-cased name to F or M; without it no name has a code")
    p.add_argument("--since-field", default="member_since", help="sign-up date of the user file")
    p.add_argument("--trees", type=int, help="trees per model, instead of the models' own setting")
    p.add_argument("--max-depth", type=int, help="upper bound on the depth of either model")
    p.add_argument("--resume", help="folder for the segments of a fit; the same call goes on from what is there")
    p.add_argument("--labels", help="ratings that evaluate compares with; default the validation file")
    p.add_argument("--train-only", action="store_true", help="leave the validation ratings out of fit and neighbours")
    p.add_argument("--bad-rows", help="folder for input rows that can't be read; without it they are left out silently")
    p.add_argument("--most-bad", type=float, default=0.01, help="share of a file's rows that may be bad before the job fails")
    p.add_argument("--spaced-header", action="store_true")
    return p


def _settings(args: argparse.Namespace) -> list[models.Boosting]:
    return [
        replace(b, trees=args.trees or b.trees, depth=min(b.depth, args.max_depth or b.depth))
        for b in (models.MODEL_A, models.MODEL_B)
    ]


def main(argv: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    if args.job == "predict" and not (args.requests and args.out):
        raise SystemExit("predict needs --requests and --out")
    if args.job == "evaluate" and not args.out:
        raise SystemExit("evaluate needs --out")
    spark = build_session(f"rateweave-{args.job}")
    at = args.data.rstrip("/")
    bad = readers.BadRows(args.bad_rows, args.most_bad) if args.bad_rows else None
    users = readers.read_users(spark, f"{at}/{args.users_file}", args.since_field, bad)
    if users.filter("member_since is not null").isEmpty():
        raise SystemExit(f"no user has the field {args.since_field!r}; name the sign-up date with --since-field")
    sources = Sources(
        users=users,
        items=readers.read_items(spark, f"{at}/{args.items_file}", bad),
        reviews=readers.read_reviews(spark, f"{at}/{args.reviews_file}", bad),
        checkins=readers.read_checkins(spark, f"{at}/{args.checkins_file}", bad),
        lookup=readers.read_lookup(spark, args.lookup) if args.lookup else None,
        order=("rated_on", "file_order"),
    )
    known = readers.read_ratings(spark, f"{at}/{args.val_file}", origin=1, bad=bad)
    validation = None if args.train_only else known
    names = [f"{args.models.rstrip('/')}/model_{tag}" for tag in ("a", "b")]
    if args.job == "train":
        stores = [args.resume and f"{args.resume.rstrip('/')}/{tag}" for tag in ("a", "b")]
        for model, path in zip(train_models(sources, validation, _settings(args), stores), names):
            models.save(model, path)
        return
    ratings = [readers.read_ratings(spark, f"{at}/{args.train_file}", origin=0, bad=bad)]
    ratings += [] if args.train_only else [known]
    fitted = (models.load(spark, names[0]), models.load(spark, names[1]))
    labels = readers.read_ratings(spark, args.labels, bad=bad) if args.labels else known
    requests = readers.read_requests(spark, args.requests, bad) if args.job == "predict" else labels.select(*PAIR)
    result = predict(requests, ratings, ("origin", "file_order"), sources, fitted)
    if args.job == "predict":
        sinks.write_predictions(result, args.out, args.spaced_header)
        return
    for name, table in zip(("error", "histogram"), evaluate_predictions(result, labels)):
        table.write.mode("overwrite").option("header", True).csv(f"{args.out.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
